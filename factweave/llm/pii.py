"""Personal data: fixed detectors as seeds, bootstrapped contextual extraction for the rest.

Emails, IP addresses, payment cards and phone numbers found by ``base_spans`` are the seed entities. Each
seed, and each other identifier-like token, hangs on the lexical patterns to its left (its last word,
and its last two words). The pattern-instance graph is aggregated over the corpus and scored in rounds:
a pattern's score is the mean score of its distinct instances (smoothed), an unseen instance's score is
that of its best pattern with enough support. Tokens at or above ``ACCEPT`` become spans of kind ``context``.

Base spans always stay. The scan is a map; graph edges are pre-aggregated per (pattern, instance), so a
hot passage is one edge, and a pattern with very many instances is spread over ``SALTS`` keys. Patterns and instances are
known by 64-bit hashes: among a billion of each, about one pair in forty is expected to share one and to take the
other's score. Positions return to their rows by a row number that is written out
before use. Defined cases: null text is empty; a null doc_id is returned as null; repeated rows repeat their spans; an empty table gives no
rows; extra columns are ignored; texts of any length are scanned whole in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import materialize, release, table
from factweave.llm.wordkernel import lean

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9._-]+")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\S+")
ROUNDS, SUPPORT, ACCEPT = 3, 5, 0.8
#: Keys that each pattern is spread over where instances meet pattern scores.
SALTS = 16


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards: the run of local characters before it, but not into the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, low = at, free
        while start > low:  # in steps, so long runs cost their length once
            piece = text[max(low, start - 64) : start]
            run = _LOCAL.search(piece)
            start -= len(run[0])
            if len(run[0]) < len(piece):
                break
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of every base match that holds, kinds numbered as in ``KINDS``."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Words:
    """The runs of a text that hold no white space, found once."""

    def __init__(self, text: str):
        self.text, self.spans = text, [m.span() for m in _RUN.finditer(text)]
        self.starts = [s for s, _ in self.spans]

    def patterns(self, start: int) -> list[str]:
        """The last word before ``start`` and the last two, whole; a token glued to text takes that piece as a word."""
        k = bisect_left(self.starts, start)
        words = [self.text[s : min(e, start)].lower() for s, e in self.spans[max(0, k - 2) : k]]
        return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]


def _tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens (six characters or more, four of them digits) outside every base span."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    last = 0
    for d in _DIGIT.finditer(text):
        if d.start() < last:
            continue
        lo = d.start()
        while lo > last and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._-")):
            lo -= 1
        m = _TOKEN.match(text, lo)
        last = m.end()
        body = m[0].strip("._-")
        s = lo + m[0].index(body)
        e = s + len(body)
        if len(body) < 6 or len(_DIGIT.findall(body)) < 4:
            continue
        k = bisect_left(starts, e)  # base spans that start before the token ends
        if not k or reach[k - 1] <= s:
            yield s, e


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
SCAN = "doc_id long, base array<struct<start:long,rank:int,end:long>>, found array<struct<start:long,end:long,value:string,seed:boolean,patterns:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        may = pc.fill_null(pc.match_substring_regex(batch.column(1), "[0-9@]"), False).to_pylist()
        base, found = [], []
        for i, maybe in enumerate(may):
            spans, around = [], []
            if maybe:
                text = batch.column(1)[i].as_py()
                spans = base_spans(text)
                words = _Words(text)
                around = [{"start": s, "end": e, "value": text[s:e], "seed": True, "patterns": words.patterns(s)} for s, _, e in spans]
                around += [{"start": s, "end": e, "value": text[s:e], "seed": False, "patterns": words.patterns(s)} for s, e in _tokens(text, spans)]
            base.append([{"start": s, "rank": k, "end": e} for s, k, e in spans])
            found.append(around)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], names=["doc_id", "base", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, found`` for every row of ``docs``; written out, so ``row`` is stable."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(slim.mapInArrow(lean(_scan), SCAN).withColumn("row", F.monotonically_increasing_id()))


def learnt_instances(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """``value, score`` of the unseen instances that the pattern-instance graph accepts."""
    seen = found.select(F.explode("found").alias("f")).select(F.xxhash64("f.value").alias("value"), "f.seed", F.explode("f.patterns").alias("pattern"))
    edges = materialize(seen.groupBy(F.xxhash64("pattern").alias("pattern"), "value").agg(F.max("seed").alias("seed")))
    salt = F.pmod("value", F.lit(SALTS)).cast("int")
    scores = None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.col("seed").cast("double")) if scores is None else edges.join(scores, "value", "left").select(
            "pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score")
        )
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 0.5)).alias("p"), F.sum("score").alias("mass")).where(F.col("mass") >= support)
        spread = patterns.select("pattern", "p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        former, scores = scores, materialize(edges.where("not seed").withColumn("salt", salt).join(spread, ["pattern", "salt"]).groupBy("value").agg(F.max("p").alias("score")))
        if former is not None:
            release(former)
    release(edges)
    return scores.where(F.col("score") >= accept)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: base spans and the spans of accepted instances."""
    found = scan(docs)
    unseen = found.select("row", F.explode("found").alias("f")).where("not f.seed").select("row", F.struct(F.col("f.start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("f.end").alias("end")).alias("s"), F.xxhash64("f.value").alias("value"))
    added = unseen.join(learnt_instances(found), "value").groupBy("row").agg(F.collect_list("s").alias("added"))
    return found.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.slice("base", 1, 0)).alias("added"))


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, (*KINDS, "context")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k, kind: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k, kind) for k, kind in enumerate(KINDS)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
