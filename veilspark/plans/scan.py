"""The scan job: texts in; masked texts, findings and the placeholder map out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrays import let
from veilspark.functions.patterns import CATEGORIES
from veilspark.functions.text import searchable
from veilspark.operators import assignments, credentials, personal, secrets
from veilspark.operators.candidates import gather, widened
from veilspark.operators.keeping import changed_values, filled, found, removed, sealing, stored
from veilspark.operators.masking import masked, segments, with_values
from veilspark.operators.naming import first_uses, named_in, number_values, reserved_numbers, unique_values
from veilspark.operators.resolve import merged, resolved
from veilspark.operators.skew import split_join
from veilspark.sources.rules import Catalogue


def enabled(categories: Iterable[str] | None) -> tuple[str, ...]:
    wanted = tuple(CATEGORIES if categories is None else categories)
    unknown = set(wanted) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    return wanted


def candidate_array(
    text: Column, categories: Iterable[str] | None = None, catalogue: Catalogue | None = None
) -> Column:
    """All candidates of one text, widened to word boundaries, before overlap resolution.

    Detectors of disabled categories are not part of the plan.
    """
    return _candidate_array(text, frozenset(enabled(categories)), catalogue or Catalogue())


@lru_cache(maxsize=16)
def _candidates_of(
    text: str, categories: frozenset[str], catalogue: Catalogue | None, context: str
) -> Column:
    """The unresolved expression does not depend on a table, so it is built once per name."""
    return _candidate_array(F.col(text), categories, catalogue or Catalogue())


@lru_cache(maxsize=16)
def _named_of(text: str, context: str) -> Column:
    return F.when(F.size("_spans") > 0, named_in(F.col(text), F.col("_spans")))


@lru_cache(maxsize=16)
def _spans_of(text: str, context: str) -> tuple[Column, Column]:
    return let(resolved(F.col("_found")), merged), with_values(F.col(text), F.col("_spans"))


def _context(df: DataFrame) -> str:
    """Expressions belong to one application; its id is never used again."""
    return df.sparkSession.sparkContext.applicationId


def _candidate_array(text: Column, on: frozenset[str], rules: Catalogue) -> Column:
    def detect(t: Column) -> Column:
        parts = []
        if on & {"keys", "privateKeys", "passwords"}:
            parts.append(secrets.rule_candidates(t, rules, set(on)))
        if on & {"keys", "passwords"}:
            parts.append(assignments.assigned(t, "passwords" in on, "keys" in on))
        if "keys" in on:
            parts.append(credentials.auth_headers(t))
        if "passwords" in on:
            parts.append(credentials.url_logins(t))
        if "email" in on:
            parts.append(personal.emails(t))
        if "ip" in on:
            parts += [personal.ipv4(t), personal.ipv6(t)]
        if "card" in on:
            parts.append(personal.cards(t))
        if "iban" in on:
            parts.append(personal.ibans(t))
        if "phone" in on:
            parts.append(personal.phones(t))
        return gather(parts)

    return let(let(searchable(text), detect), lambda found: widened(text, found))


def candidates(
    df: DataFrame,
    text: str,
    ids: Sequence[str],
    categories: Iterable[str] | None = None,
    catalogue: Catalogue | None = None,
) -> DataFrame:
    """One row per candidate. Reads every text once and shuffles nothing."""
    found = _candidates_of(text, frozenset(enabled(categories)), catalogue, _context(df))
    return (
        df.select(*ids, found.alias("_found"))
        .select(*ids, F.explode_outer("_found").alias("_c"))
        .where(F.col("_c").isNotNull())
        .select(*ids, "_c.*")
    )


def span_rows(
    df: DataFrame,
    text: str,
    ids: Sequence[str],
    categories: Iterable[str] | None = None,
    catalogue: Catalogue | None = None,
) -> DataFrame:
    """``(ids, text, _spans)`` with the final spans and their values; no shuffle."""
    found = _candidates_of(text, frozenset(enabled(categories)), catalogue, _context(df))
    spans, valued = _spans_of(text, _context(df))
    return (
        df.select(*ids, text, found.alias("_found"))
        .select(*ids, text, spans.alias("_spans"))
        .select(*ids, text, valued.alias("_spans"))
    )


@dataclass(frozen=True)
class ScanResult:
    """Lazy results of one scan.

    ``rows`` holds one row per text with the nested spans; the tables below are
    projections of it, so a caller that needs several of them should take them
    from ``kept()``, which runs the detectors once.
    """

    rows: DataFrame
    ids: tuple[str, ...]
    text: str
    scope: str | None = None
    scope_map: DataFrame | None = None

    @property
    def masked(self) -> DataFrame:
        """``(ids, masked)``."""
        return self.rows.select(*self.ids, masked(F.col(self.text), F.col("_spans")).alias("masked"))

    def _span_table(self) -> DataFrame:
        """``(ids, _spans)`` with values as ``_opened`` takes them."""
        return self.rows

    def _opened(self, value: Column) -> Column:
        return value

    def _exploded(self) -> DataFrame:
        return (
            self._span_table().select(*self.ids, F.explode_outer("_spans").alias("_s"))
            .where(F.col("_s").isNotNull())
        )

    @property
    def findings(self) -> DataFrame:
        """``(ids, start, end, category, rule, placeholder)``; never a value."""
        return self._exploded().select(
            *self.ids, *[F.col(f"_s.{c}").alias(c) for c in ("start", "end", "category", "rule", "placeholder")]
        )

    @property
    def occurrences(self) -> DataFrame:
        """Findings together with label and value, for reports that may see values."""
        return self._exploded().select(*self.ids, "_s.*").withColumn("value", self._opened(F.col("value")))

    @property
    def map(self) -> DataFrame:
        """``(scope, placeholder, value)``: the only result that holds real values."""
        if self.scope_map is not None:
            return self.scope_map.select(self.scope, "placeholder", "value")
        return (
            self._span_table().select(*self.ids, F.explode_outer(first_uses(F.col("_spans"))).alias("_m"))
            .where(F.col("_m").isNotNull())
            .select(*self.ids, "_m.placeholder", self._opened(F.col("_m.value")).alias("value"))
        )

    @property
    def segments(self) -> DataFrame:
        """``(ids, part, original, shown, placeholder)`` in text order."""
        parts = segments(F.col(self.text), F.col("_spans"))
        return (
            self.rows.select(*self.ids, parts.alias("_parts"))
            .select(*self.ids, F.posexplode_outer("_parts").alias("part", "_p"))
            .where(F.col("_p").isNotNull())
            .select(*self.ids, "part", "_p.original", "_p.shown", "_p.placeholder")
        )

    def create_views(self) -> None:
        """Register ``masked``, ``findings`` and ``placeholder_map`` for SQL."""
        self.masked.createOrReplaceTempView("masked")
        self.findings.createOrReplaceTempView("findings")
        self.map.createOrReplaceTempView("placeholder_map")

    def kept(self, folder: str | None = None) -> KeptScan:
        """The same results from rows that are written once, now, to the shared folder.

        What is written holds the plain parts of the texts and sealed values. ``discard`` deletes it. A ``folder`` of
        the caller's choice is written over.
        """
        seal, unseal = sealing()
        parts, folder = stored(self.rows, self.ids, self.text, seal, folder)
        return KeptScan.of(parts, folder, unseal, self.ids, self.text, self.scope, self.scope_map)


@dataclass(frozen=True)
class KeptScan(ScanResult):
    """Results of a scan whose rows lie in the shared folder; values are only opened where they are shown."""

    parts: DataFrame = field(kw_only=True)
    folder: str = field(kw_only=True)
    unseal: Callable[[Column], Column] = field(kw_only=True)

    @staticmethod
    def of(
        parts: DataFrame, folder: str, unseal: Callable[[Column], Column], ids: Sequence[str], text: str,
        scope: str | None, scope_map: DataFrame | None,
    ) -> KeptScan:
        spans = changed_values(parts, unseal)
        rows = parts.select(
            *ids, filled(F.col("_gaps"), spans, lambda s: s["value"]).alias(text), spans.alias("_spans")
        )
        return KeptScan(rows, tuple(ids), text, scope, scope_map, parts=parts, folder=folder, unseal=unseal)

    @property
    def masked(self) -> DataFrame:
        """``(ids, masked)``."""
        hidden = filled(F.col("_gaps"), F.col("_spans"), lambda s: s["placeholder"])
        return self.parts.select(*self.ids, hidden.alias("masked"))

    def _span_table(self) -> DataFrame:
        return self.parts

    def _opened(self, value: Column) -> Column:
        return self.unseal(value)

    def kept(self, folder: str | None = None) -> KeptScan:
        return self

    def discard(self) -> None:
        """Delete the written rows; the results can't be read after that."""
        removed(self.parts.sparkSession, self.folder)


def scan(
    df: DataFrame,
    text: str,
    ids: Sequence[str],
    categories: Iterable[str] | None = None,
    scope: str | None = None,
    order: Sequence[str] = (),
    catalogue: Catalogue | None = None,
) -> ScanResult:
    """Find and mask sensitive values.

    Without ``scope`` every row is numbered on its own and the whole job is one
    pass over the data without a shuffle. With ``scope`` (for example a
    conversation id) equal values share a placeholder across the rows of the
    scope, numbered in the order of the ``order`` columns.
    """
    rows = span_rows(df, text, ids, categories, catalogue)
    if scope is None:
        named_rows = rows.select(*ids, text, _named_of(text, _context(df)).alias("_spans"))
        return ScanResult(named_rows, tuple(ids), text)
    return _scan_scope(df, rows, text, ids, scope, order)


def _scan_scope(
    df: DataFrame, rows: DataFrame, text: str, ids: Sequence[str], scope: str, order: Sequence[str]
) -> ScanResult:
    if scope not in ids or not set(order) <= set(ids):
        raise ValueError("scope and order must be id columns")
    # The texts are scanned once. What is written holds plain parts and sealed values only.
    seal, unseal = sealing()
    parts, folder = stored(rows, ids, text, seal)
    spans = (
        parts.select("_row", *ids, F.explode_outer("_spans").alias("_s"))
        .where(F.col("_s").isNotNull())
        .select("_row", *ids, "_s.*")
    )
    names = number_values(
        unique_values(spans, scope, [*order, "start"]), reserved_numbers(df, text, scope), scope
    )
    # The map holds a value of a scope once, so the rows of a frequent value need no exchange.
    issued = names.select(F.col(scope).alias("_scope"), F.col("value").alias("_value"), "placeholder")
    fields = ("start", "end", "category", "label", "rule", "value", "placeholder")
    per_row = (
        split_join(spans, issued, [(scope, "_scope"), ("value", "_value")])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_spans"))
    )
    # Texts without findings, most of them, pass by the join.
    plain = parts.where(~found(F.col("_spans"))).select(
        *ids, "_gaps", F.lit(None).cast(per_row.schema["_spans"].dataType).alias("_spans")
    )
    hit = parts.where(found(F.col("_spans"))).drop("_spans").join(per_row, "_row").select(*ids, "_gaps", "_spans")
    opened = names.withColumn("value", unseal(F.col("value")))
    return KeptScan.of(plain.unionByName(hit), folder, unseal, ids, text, scope, opened)
