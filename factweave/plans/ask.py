"""Evidence for a question about a corpus: which artifacts it names, what sets them apart, what they lack.

Everything is a bounded query; the prompt is plain text, and sending it anywhere is left to the caller."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import consensus
from factweave.plans.corpus import Corpus

FOCUS, TABLE, FACTIONS, MEMBERS, DEVIATIONS, UNIQUE, MISSING = 4, 30, 6, 8, 5, 25, 25
#: Separators of a question's words, and words that never name an artifact.
SEPARATORS = " \t\n\r?!,;:'\"()[]{}"
STOPWORDS = frozenset(
    "the and why what how is are does did from with that this file files than diff differ different about for who which compare compared other others rest everything all".split()
    + "yaml yml json md txt conf toml ini cfg env".split()
)
SYSTEM = "Answer from the evidence below only. Name the artifacts and facts you rely on, and say so when the evidence does not settle the question."


def question_words(question: str) -> list[str]:
    """Words of three bytes or more, A-Z lower-cased, that could name a path: dots and slashes stay inside."""
    lower = question.translate({c: c + 32 for c in range(65, 91)})
    words = (w.strip(".") for w in re.split("[" + re.escape(SEPARATORS) + "]+", lower))
    return [w for w in dict.fromkeys(words) if len(w.encode()) >= 3 and w not in STOPWORDS]


def focus_by_words(artifacts: DataFrame, question: str) -> DataFrame:
    """The first artifacts whose path contains a word of the question."""
    words = question_words(question)
    if not words:
        return artifacts.limit(0)
    lower = F.translate("path", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: lower.contains(w))
    return artifacts.where(hit).orderBy("artifact_id").limit(FOCUS)


def focus(corpus: Corpus, question: str) -> list[int]:
    """Artifacts named by the question, else outliers, else the most drifted one."""
    named = [r[0] for r in focus_by_words(corpus.artifacts.select("artifact_id", "path"), question).collect()]
    if named:
        return named
    ranked = corpus.stats.orderBy(F.desc("drift"), "artifact_id")
    flagged = [r[0] for r in ranked.where("is_outlier").limit(FOCUS).select("artifact_id").collect()]
    if flagged:
        return flagged
    top = ranked.limit(2).select("artifact_id").collect()
    return [top[0][0]] if len(top) > 1 else []


def evidence(corpus: Corpus, question: str) -> str:
    """The evidence as text."""
    chosen = focus(corpus, question)
    s = corpus.summary.first()
    out = [f"Corpus: {s['artifacts']} artifacts, {s['observations']} observations, {s['identities']} identities, {s['core']} in the consensus core."]
    ranked = corpus.stats.orderBy(F.desc("drift"), "artifact_id")
    rows = {r["artifact_id"]: r for r in [*ranked.limit(TABLE).collect(), *corpus.stats.where(F.col("artifact_id").isin(chosen)).collect()]}
    out += ["", "Artifacts by drift:"] + [f"  {r['path']}  drift {r['drift']:.4f}  facts {r['total']}  unique {r['n_unique']}{'  OUTLIER' if r['is_outlier'] else ''}" for r in rows.values()]
    labels, table, signature = corpus.factions
    paths = corpus.artifacts.select("artifact_id", "path")
    for f in table.orderBy("faction_id").limit(FACTIONS).collect():
        names = [r[0] for r in labels.where(F.col("root") == f["root"]).join(paths, "artifact_id").orderBy("artifact_id").limit(MEMBERS).select("path").collect()]
        out += ["", f"Faction {f['faction_id']}: {f['size']} members ({', '.join(names)}), cohesion {f['cohesion']:.3f}"]
        out += [f"  shares {r['canonical']} ({r['present']} of {f['size']})" for r in signature.where(F.col("root") == f["root"]).orderBy("rank").limit(DEVIATIONS).collect()]
    for a in chosen:
        out += ["", f"Focus: {rows[a]['path']}"]
        own = corpus.identities.where(F.col("is_unique") & (F.col("holder") == a)).orderBy("holder_ord").limit(UNIQUE)
        out += [f"  only here: {r['canonical']}" for r in own.collect()]
        out += [f"  missing: {r['canonical']} (held by {r['k']})" for r in consensus.missing_core(a, corpus.members, corpus.identities, MISSING).collect()]
    return "\n".join(out)


def prompt(corpus: Corpus, question: str) -> str:
    """What a dry run prints: instructions, evidence, question."""
    return f"{SYSTEM}\n\n{evidence(corpus, question)}\n\nQuestion: {question}"
