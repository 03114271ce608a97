"""A corpus: artifacts and facts, and the analyses over them as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from factweave.functions.graph import materialize, release
from factweave.operators import conflicts, consensus, creds, factions, gate, signatures
from factweave.operators.dictionary import encoded
from factweave.sources.content import form_rows, from_rows
from factweave.sources.rows import keys_only, table_artifacts, text_facts


@dataclass
class Corpus:
    """``artifacts(artifact_id, path, kind, size)`` and ``facts(artifact_id, ord, kind, canonical, line)``.

    ``reused=True`` writes the membership and identity tables once to the shared folder, for callers that
    derive many results; single-query callers leave it off and let the plan stream. Analyses that read the membership more than
    once (``stats``, ``summary``, ``factions``, ``exclusive``) turn it on. ``release`` deletes what was written.

    ``forms``: those facts that tell of forms, from sources that read them without the others.

    ``pair_cap``: holders beyond which a minority identity is not distinctive, as the definition has it; ``None`` counts them all."""

    artifacts: DataFrame
    facts: DataFrame
    reused: bool = False
    forms: DataFrame | None = None
    pair_cap: int | None = factions.PAIR_CAP
    written: list[DataFrame] = field(default_factory=list, repr=False)

    @classmethod
    def from_lines(cls, df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> Corpus:
        """Each row an artifact, each line that is not blank a fact."""
        return cls(table_artifacts(df, id_col, path and df[path]), text_facts(df, id_col, text_col))

    @classmethod
    def from_sources(cls, extracted: tuple[DataFrame, DataFrame], reused: bool = True) -> Corpus:
        """From the file, web or byte-row sources, which return ``(artifacts, facts)``."""
        return cls(*extracted, reused)

    @classmethod
    def from_rows(cls, rows: DataFrame, reused: bool = True) -> Corpus:
        """From byte rows ``artifact_id, path, kind, content``."""
        return cls(*from_rows(rows), reused, form_rows(rows))

    def keys_only(self) -> Corpus:
        return Corpus(self.artifacts, keys_only(self.facts), self.reused, pair_cap=self.pair_cap)

    def _held(self, df: DataFrame) -> DataFrame:
        if not self.reused:
            return df
        self.written.append(materialize(df))
        return self.written[-1]

    def release(self) -> None:
        """Delete the written tables; results read from them are gone too."""
        release(*self.written)
        self.written.clear()

    @cached_property
    def members(self) -> DataFrame:
        return self._held(consensus.membership(self.facts))

    @cached_property
    def identities(self) -> DataFrame:
        return self._held(consensus.identities(self.artifacts, self.facts, self.members))

    @cached_property
    def stats(self) -> DataFrame:
        self.reused = True
        return self._held(consensus.with_outliers(consensus.artifact_stats(self.artifacts, self.members, self.identities)))

    @cached_property
    def summary(self) -> DataFrame:
        self.reused = True  # before the identities are read
        return consensus.corpus_summary(self.artifacts, self.facts, self.identities, self.stats)

    @cached_property
    def conflicts(self) -> DataFrame:
        return conflicts.conflicts(self.members)

    @cached_property
    def credential_forms(self) -> DataFrame:
        """From the membership where it is there already, else from the form facts alone."""
        held = self.members if "members" in self.__dict__ else self.facts if self.forms is None else self.forms
        return creds.credential_forms(self.artifacts, held)

    @cached_property
    def _rare(self) -> tuple[DataFrame, DataFrame]:
        """The distinctive identities by name, and the membership in them."""
        self.reused = True
        names = factions.distinctive(self.identities, written=True, cap=self.pair_cap)
        self.written.append(names)
        return names, self._held(encoded(self.members, names))

    @cached_property
    def _classes(self) -> tuple[DataFrame, DataFrame]:
        """Classes of artifacts with the same distinctive identities, and the class of each artifact."""
        self.written.extend(found := factions.classes(self._rare[1]))
        return found

    @cached_property
    def _edges(self) -> DataFrame:
        """Between artifacts, or between classes where no cap bounds the holders of an identity."""
        if self.pair_cap is not None:
            return self._held(factions.similarity_edges(self._rare[1]))
        self.written.append(factions.class_edges(self._classes[0]))
        return self.written[-1]

    @cached_property
    def faction_labels(self) -> DataFrame:
        """``artifact_id, root`` of the members of factions."""
        self.reused = True
        return self._held(factions.faction_members(self._edges) if self.pair_cap is not None else factions.class_members(self._edges, self._classes[1]))

    @cached_property
    def faction_table(self) -> DataFrame:
        return self._held(factions.faction_table(self.faction_labels, self._edges))

    @cached_property
    def faction_signature(self) -> DataFrame:
        names, rare = self._rare
        return self._held(factions.faction_signature(self.faction_labels, rare, names))

    @property
    def factions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(labels, factions, signature)``; who needs one takes it alone."""
        return self.faction_labels, self.faction_table, self.faction_signature

    @cached_property
    def exclusive(self) -> DataFrame:
        self.reused = True  # before the membership is read
        return signatures.exclusive_facts(self.members, self.identities, self.faction_labels)

    @cached_property
    def kits(self) -> DataFrame:
        return signatures.kit_signatures(self.exclusive, self.faction_table)

    @cached_property
    def atoms(self) -> DataFrame:
        return signatures.yara_atoms(self.exclusive, self.faction_table)

    def gate(self, spec: str) -> DataFrame:
        return gate.evaluate(gate.metrics(self.conflicts, self.stats, self.credential_forms), gate.parse(spec))
