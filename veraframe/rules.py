"""The catalogue of checks: one row for each rule, by which severity and dimension are looked up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIMENSIONS = ("study", "dataset", "variable", "value", "codelist", "method", "comment", "document", "ct", "arm")
SEVERITIES = ("error", "warning", "note")

#: Id, dimension, severity, engine, needs data, scope, status.
_CATALOG = """
study_name_present study warning spec no scoped implemented
dataset_label_present dataset warning spec no scoped implemented
dataset_keys_resolve dataset error spec no scoped implemented
dataset_comment_resolves dataset error spec no scoped implemented
variable_label_present variable note spec no scoped implemented
variable_length_positive variable error spec no scoped implemented
variable_sigdigits_nonneg variable error spec no scoped implemented
variable_method_resolves variable error spec no scoped implemented
variable_comment_resolves variable error spec no scoped implemented
variable_derived_has_method variable warning spec no scoped implemented
variable_order_positive variable error spec no scoped implemented
variable_length_for_text variable warning spec no scoped implemented
value_whereclause_present value error spec no scoped implemented
value_variable_resolves value warning spec no scoped implemented
value_method_resolves value error spec no scoped implemented
value_comment_resolves value error spec no scoped implemented
value_codelist_resolves value error spec no scoped implemented
codelist_comment_resolves codelist error spec no scoped implemented
codelist_terms_present codelist warning spec no scoped implemented
method_id_unique method error spec no scoped implemented
method_description_present method warning spec no scoped implemented
method_document_resolves method note spec no scoped implemented
comment_id_unique comment error spec no scoped implemented
comment_description_present comment warning spec no scoped implemented
comment_document_resolves comment note spec no scoped implemented
document_id_unique document error spec no scoped implemented
method_unused method note spec no whole-spec implemented
comment_unused comment note spec no whole-spec implemented
document_unused document note spec no whole-spec implemented
ct_value_in_codelist ct warning spec yes scoped implemented
ct_term_unused ct note spec yes scoped implemented
variable_present_in_data variable warning spec yes scoped implemented
variable_name_length variable warning spec no scoped implemented
variable_label_length variable warning spec no scoped implemented
cross_dataset_label variable note spec no whole-spec implemented
cross_dataset_type variable warning spec no whole-spec implemented
key_sequence_contiguous dataset error spec no scoped implemented
key_sequence_matches_keys dataset warning spec no scoped implemented
variable_order_unique variable warning spec no scoped implemented
itemoid_unique variable error spec no scoped implemented
missing_variable variable error data yes scoped implemented
extra_variable variable warning data yes scoped implemented
type_mismatch variable note data yes scoped implemented
invalid_encoding variable error data yes scoped implemented
length_overflow variable warning data yes scoped implemented
codelist_membership ct error data yes scoped implemented
display_format variable warning data yes scoped implemented
missing_permissible variable warning data yes scoped implemented
char_length_limit variable warning data yes scoped implemented
label_match variable note data yes scoped implemented
key_uniqueness dataset error data yes scoped implemented
variable_name variable warning data yes scoped implemented
dataset_name dataset warning data yes scoped implemented
label_length variable warning data yes scoped implemented
integer_overflow variable error data yes scoped implemented
codelist_membership_extensible ct note data yes scoped implemented
arm_result_metadata arm error spec no scoped deferred
codelist_term_standard_ct codelist warning spec no scoped deferred
codelist_decode_present codelist note spec no scoped deferred
integer_fraction variable error data yes scoped implemented
iso8601_format variable error data yes scoped implemented
"""


@dataclass(frozen=True)
class Rule:
    id: str
    dimension: str
    severity: str
    engine: str
    needs_data: bool
    scope: str
    status: str


@lru_cache(1)
def catalog() -> dict[str, Rule]:
    """All rules by id; a malformed catalogue is an error at first use."""
    rules = [Rule(a, b, c, d, e == "yes", f, g) for a, b, c, d, e, f, g in (line.split() for line in _CATALOG.split("\n") if line)]
    found = {r.id: r for r in rules}
    for r in rules:
        if r.dimension not in DIMENSIONS or r.severity not in SEVERITIES or r.engine not in ("spec", "data") or r.engine == "data" and not r.needs_data:
            raise ValueError(f"rule {r.id} is malformed")
    if len(found) != len(rules):
        raise ValueError("rule ids repeat")
    return found


@dataclass(frozen=True)
class Finding:
    """One row of the findings relation."""

    check: str
    dimension: str
    severity: str
    dataset: str | None
    variable: str | None
    message: str


def finding(check: str, message: str, dataset: str | None = None, variable: str | None = None) -> Finding:
    r = catalog()[check]
    return Finding(check, r.dimension, r.severity, dataset, variable, message)


FINDINGS = T.StructType([T.StructField(n, T.StringType()) for n in ("check", "dimension", "severity", "dataset", "variable", "message")])


def findings_frame(spark: SparkSession, found: list[Finding]) -> DataFrame:
    """Findings as a DataFrame of six text columns, in their order."""
    return spark.createDataFrame([(f.check, f.dimension, f.severity, f.dataset, f.variable, f.message) for f in found], FINDINGS)


def by_severity(found: list[Finding]) -> dict[str, int]:
    return {s: sum(f.severity == s for f in found) for s in SEVERITIES}


def report(found: list[Finding], title: str, most: int = 15) -> str:
    """Findings as text: a section for each severity, at most ``most`` lines in each."""
    lines = [title]
    for s in SEVERITIES:
        own = [f for f in found if f.severity == s]
        if own:
            lines.append(f"{s} ({len(own)})")
            lines += [f"  {f.check} [{'.'.join(x for x in (f.dataset, f.variable) if x)}] {f.message}" for f in own[:most]]
            if len(own) > most:
                lines.append(f"  and {len(own) - most} more")
    return "\n".join(lines if len(lines) > 1 else [*lines, "no findings"])
