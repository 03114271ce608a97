"""Quality rules as a bitmask ledger.

``rule_ledger`` evaluates every rule once per document and stores the measurements and one long of
failure bits. Policies are versioned sets of bits applied later with one AND; ablations are sums over
the same bits. Nothing is re-measured when a policy changes.

Defined cases: a null text counts as empty (no words, all measurements 0, fails ``few_words``);
a null doc_id is returned as null; repeated rows give repeated ledger rows; an empty table gives an empty ledger; other columns are not
read. Texts of any length are measured whole, one row at a time in bounded chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import table
from factweave.llm.wordkernel import IS_SEP, Words, gram_hashes, lean, mix, word_chunks

#: Rule name -> bit. A bit, once given, keeps its meaning in every later policy.
RULES = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "duplicate_lines": 3, "word_length": 4}
#: Policy version -> rules that reject.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length")}

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, fail_bits long"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"
_WINDOW = 8


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _repeats(w: Words, n: int = _WINDOW) -> np.ndarray:
    """Per row, the words inside an n-word window that occurs at least twice in the row."""
    h = gram_hashes(w.hashes, n)
    if not len(h):
        return np.zeros(w.rows, dtype=np.int64)
    row = w.row_of_word()
    at = np.flatnonzero(row[: len(h)] == row[n - 1 : n - 1 + len(h)])
    key = mix(h[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    twin = key[order[1:]] == key[order[:-1]]
    same[order[1:][twin]] = True
    same[order[:-1][twin]] = True
    steps = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    np.add.at(steps, at[same], 1)
    np.add.at(steps, at[same] + n, -1)
    return _per_row(np.cumsum(steps[:-1]) > 0, w.bounds)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def _measured(w: Words) -> dict[str, np.ndarray]:
    """Every measurement of every row, and ``fail_bits``."""
    letters = ~IS_SEP[w.buf] & ((w.buf & 0xC0) != 0x80)
    lines = np.array([_lines(w.text(i)) for i in range(w.rows)], dtype=np.int64).reshape(-1, 2)
    m = dict(zip(_NAMES, (w.counts, _per_row(letters, w.offsets), _per_row(_SYMBOL[w.buf], w.offsets), lines[:, 1], lines[:, 0], _repeats(w))))
    n = m["n_words"]
    fails = {
        "few_words": n < 20,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * n,
        "symbols": 2 * m["n_symbols"] > n,
        "duplicate_lines": (2 * m["n_dup_lines"] > m["n_lines"]) & (m["n_lines"] > 3),
        "word_length": (n > 0) & ((m["word_chars"] < 2 * n) | (m["word_chars"] > 25 * n)),
    }
    m["fail_bits"] = sum(bad.astype(np.int64) << RULES[r] for r, bad in fails.items())
    return m


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in word_chunks(batch.column(1)):
            m = _measured(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.rows), *(pa.array(c.astype(np.int64)) for c in m.values())], names=["doc_id", *m])


def rule_ledger(docs: DataFrame) -> DataFrame:
    """One row of measurements per row of ``docs`` (``doc_id``, ``text``), with ``fail_bits``: bit
    ``RULES[r]`` is set where rule ``r`` rejects."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_measure), LEDGER)


def keep_documents(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The rows of ``docs`` that no rule of the policy rejects, all columns kept; no shuffle."""
    at, mask = docs.columns.index("text"), policy_mask(version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_measured(w)["fail_bits"] for w in word_chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(bits) & mask == 0) if bits else pa.array([], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def policy_mask(version: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[version])


def apply_policy(ledger: DataFrame, version: str = "v1") -> DataFrame:
    """Adds ``kept``: no bit of the policy is set."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablation(ledger: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: documents failing it, and documents it alone rejects (what dropping the
    rule would keep). One partial aggregation over the bits."""
    mask = policy_mask(version)
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask))
    aggs = []
    for r in POLICIES[version]:
        bit = F.lit(1 << RULES[r])
        aggs.append(F.count_if(hit.bitwiseAND(bit) != 0).alias(f"{r}_fails"))
        aggs.append(F.count_if(hit == bit).alias(f"{r}_alone"))
    one = ledger.agg(*aggs)
    stack = ", ".join(f"'{r}', {r}_fails, {r}_alone" for r in POLICIES[version])
    return one.selectExpr(f"stack({len(POLICIES[version])}, {stack}) as (rule, fails, alone)")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w
  FROM d),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
b AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM m LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines AND n_lines > 3 THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END AS fail_bits
  FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM f
"""
