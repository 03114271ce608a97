"""Pages that harvest credentials, from the form facts of the HTML extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Substrings that classify a field name.
PASSWORD_WORDS = ("pass", "pwd")
SENSITIVE_WORDS = ("user", "login", "card", "cvv", "cvc", "ssn", "pin", "otp", "iban", "routing", "account", "credit", "secret", "seed", "mnemonic", "recovery", "swift")


def classify_field(name: Column) -> Column:
    """``password``, ``sensitive`` or null."""
    return F.when(name.rlike("|".join(PASSWORD_WORDS)), "password").when(name.rlike("|".join(SENSITIVE_WORDS)), "sensitive")


def page_host(path: Column) -> Column:
    host = F.regexp_extract(path, r"^(?i:https?)://([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def form_facts(facts: DataFrame) -> DataFrame:
    """The facts that ``credential_forms`` looks at."""
    return facts.where((F.col("kind") == "kv") & (F.col("canonical").startswith("field[]=") | F.col("canonical").startswith("formhost[]=")))


def credential_forms(artifacts: DataFrame, facts: DataFrame) -> DataFrame:
    """``artifact_id, path, fields, action_host, off_domain``: a password field, or two distinct sensitive ones. ``facts`` may be a
    membership or hold a fact more than once: fields are sets, hosts count by their first place."""
    field = F.when(F.col("canonical").startswith("field[]="), F.substr("canonical", F.lit(9)))
    host = F.when(F.col("canonical").startswith("formhost[]="), F.substr("canonical", F.lit(12)))
    rows = form_facts(facts).select("artifact_id", "ord", field.alias("field"), host.alias("host"))
    rows = rows.withColumn("class", classify_field(F.col("field"))).where("class is not null or host is not null")
    pages = rows.groupBy("artifact_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("class").isNotNull(), F.col("field")))).alias("fields"),
        F.coalesce(F.bool_or(F.col("class") == "password"), F.lit(False)).alias("password"),
        F.min_by("host", F.when(F.col("host").isNotNull(), F.col("ord"))).alias("action_host"),
    ).where("password or size(fields) >= 2")  # without a password all its fields are sensitive ones
    j = pages.join(artifacts.select("artifact_id", "path"), "artifact_id")
    own = page_host(F.col("path"))
    off = own.isNotNull() & F.col("action_host").isNotNull() & (own != F.lower("action_host"))
    return j.select("artifact_id", "path", "fields", "action_host", off.alias("off_domain"))


def ungrouped_forms(forms: DataFrame, labels: DataFrame) -> DataFrame:
    """Forms whose page belongs to no faction."""
    return forms.join(labels.select("artifact_id"), "artifact_id", "left_anti")
