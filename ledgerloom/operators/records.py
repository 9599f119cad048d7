"""Records and captures: refreshing records, resolving versions against windows, classifying evidence, listing cards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates, versions
from ledgerloom.functions.text import known, normal
from ledgerloom.operators.dedupe import keep_first
from ledgerloom.operators.gates import first_failure
from ledgerloom.operators.temporal import active_at, release_windows

KEY = ["product_id", "update_version"]


def refresh_records(
    stored: DataFrame, incoming: DataFrame, fill: list[str], replace: list[str], follow: list[str], checked: str = "source_last_checked", attempts: str = "official_source_attempts", most: int = 5
) -> DataFrame:
    """Stored records after a scan, with ``action``: created, refreshed, freshness-updated or unchanged.

    ``fill`` fields are set where blank; ``replace`` fields take incoming text
    that is known and different; ``follow`` fields take any incoming value
    that is not null. ``checked`` is always the incoming one; it is also added
    to ``attempts``, of which the last ``most`` stay. Of several incoming rows
    of a key the last checked counts.
    """
    newest = keep_first(incoming, [F.col(k) for k in KEY], [F.desc(checked)])
    values = [*fill, *replace, *follow, checked]
    a = stored.select(*KEY, F.struct(*values, attempts).alias("was"))
    b = newest.select(*KEY, F.struct(*values).alias("now"))
    both = a.join(b, KEY, "full_outer")
    was, now = F.col("was"), F.col("now")
    after = {c: F.when(known(was[c]).isNull(), now[c]).otherwise(was[c]) for c in fill}
    after |= {c: F.when(known(now[c]).isNotNull() & ~normal(now[c]).eqNullSafe(normal(was[c])), now[c]).otherwise(was[c]) for c in replace}
    after |= {c: F.coalesce(now[c], was[c]) for c in follow}
    differs = F.lit(False)
    for c, value in after.items():
        differs = differs | ~value.eqNullSafe(was[c])
    action = (
        F.when(was.isNull(), "created").when(now.isNull(), "unchanged").when(differs, "refreshed")
        .when(~now[checked].eqNullSafe(was[checked]), "freshness-updated").otherwise("unchanged")
    )
    tried = F.concat(F.coalesce(was[attempts], F.array().cast("array<string>")), F.when(now.isNotNull(), F.array(now[checked])).otherwise(F.array().cast("array<string>")))
    tail = F.slice(tried, F.greatest(F.size(tried) - most + 1, F.lit(1)), most)
    return both.select(*KEY, *[v.alias(c) for c, v in after.items()], F.coalesce(now[checked], was[checked]).alias(checked), tail.alias(attempts), action.alias("action"))


def resolve_versions(reports: DataFrame, records: DataFrame, current: str = r"(?i)\b(?:latest|current|newest)\s+(?:version|release|update|build)\b") -> DataFrame:
    """Reports with ``update_version, match_basis, confidence, rejection_reason, window_start, window_end``.

    Reports have ``report_id, product_id, report_text, at`` (timestamp or
    null) and ``precision``; records ``product_id, update_version,
    update_published_at``. A full version (two points or more) must be the
    only one named and agree with the release that was active; a short one
    must be the start of the active release; without any, only the words for
    the current release attribute the report to it. Coarse dates within a day
    of a release decide nothing.
    """
    starts = records.select("product_id", F.col("update_version").alias("window_version"), dates.parse_iso(F.col("update_published_at")).alias("window_start"),
                            versions.channel(F.col("update_version")).alias("channel")).where("window_start IS NOT NULL")
    windows = release_windows(starts, ("product_id", "channel"), "window_start", versions.int_tuple(F.col("window_version")))
    said = reports.withColumn("channel", versions.channel(F.col("report_text"))).withColumn("named", F.array_distinct(versions.all_mentions(F.col("report_text"))))
    dated = active_at(said.where("at IS NOT NULL"), windows, ("product_id", "channel"), "at", "window_start", "window_version", ("window_version", "window_start", "window_end"))
    undated = said.where("at IS NULL").select(*dated.columns[: len(said.columns)], *[F.lit(None).cast(t).alias(c) for c, t in dated.dtypes[len(said.columns) :]])
    rows = dated.unionByName(undated)

    points = lambda v: F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))
    full, short = F.filter("named", lambda v: points(v) >= 2), F.filter("named", lambda v: points(v) == 1)
    version, active = F.get(full, F.lit(0)), F.col("window_version")
    near = F.col("precision").isin("day", "coarse") & dates.near_boundary(F.col("at"), F.col("window_start"), F.col("window_end"))
    fits = F.exists(short, lambda s: F.coalesce(versions.short_matches(s, active), F.lit(False)))
    exact_short = F.array_contains(short, active)
    is_full, is_short = F.size(full) > 0, F.size(short) > 0
    inferred = ~is_full
    reason = first_failure(
        [
            ("conflicting_exact_version_mentions", is_full & (F.size(full) > 1)),
            ("conflicting_exact_version_for_active_release_window", is_full & active.isNotNull() & ~versions.short_matches(active, version)),
            ("missing_exact_patch_version_match", inferred & ~is_short & ~F.coalesce(F.col("report_text").rlike(current), F.lit(False))),
            ("missing_resolvable_source_date_for_inferred_match", inferred & F.col("at").isNull()),
            ("source_date_outside_release_windows", inferred & active.isNull()),
            ("truncated_version_outside_active_release_window", inferred & is_short & ~fits),
            ("source_date_too_coarse_near_release_boundary", inferred & near),
        ]
    )
    basis = F.when(is_full | (is_short & exact_short), "exact_version").when(is_short, "truncated_version_in_release_window").otherwise("release_window_inferred")
    confidence = F.when(is_full | (is_short & exact_short), "exact").when(is_short, "inferred_truncated_window").otherwise("inferred_release_window")
    ok = reason.isNull()
    return rows.select(
        *[c for c in reports.columns], F.when(ok, F.when(is_full, version).otherwise(active)).alias("update_version"), F.when(ok, basis).alias("match_basis"),
        F.when(ok, confidence).alias("confidence"), reason.alias("rejection_reason"), "window_start", "window_end",
    )


def lenient_inclusion() -> list[tuple[str, Column]]:
    """The looser chain: a match flag or the version anywhere in titles or excerpt, no URL asked for; stored reasons stay."""
    said = F.lower(F.concat_ws(" ", "parent_title", "report_title", "report_text_excerpt"))
    version = F.lower(normal(F.col("update_version")))
    specific = F.col("patch_version_matched").eqNullSafe(F.lit(True)) | ((version != "") & F.contains(said, version))
    return [
        ("not_patch_specific", ~specific),
        ("counted_false", F.col("counted").eqNullSafe(F.lit(False))),
        ("invalid_sentiment", ~F.lower(normal(F.col("sentiment"))).isin(*buckets.SENTIMENTS)),
    ]


def revalidation_class(core: tuple[str, ...], adapters: tuple[str, ...], pending: tuple[str, ...]) -> Column:
    """Class of a stored row: malformed, without URL, ready for its adapter, waiting for one, or unsupported."""
    missing = F.lit(False)
    for c in core:
        missing = missing | known(F.col(c)).isNull()
    return (
        F.when(missing | ~F.col("patch_version_matched").eqNullSafe(F.lit(True)), "malformed_row").when(known(F.col("source_url")).isNull(), "missing_url")
        .when(F.col("source_type").isin(*adapters), "candidate_for_revalidation").when(F.col("source_type").isin(*pending), "pending_source_adapter")
        .otherwise("unsupported_source_type")
    )


def class_totals(rows: DataFrame, label: Column, classes: tuple[str, ...]) -> DataFrame:
    """Counts over a fixed list of classes, zeros included, in one scan."""
    counted = rows.agg(*[F.count_if(label == c).alias(c) for c in classes])
    pairs = ", ".join(f"'{c}', `{c}`" for c in classes)
    return counted.select(F.expr(f"stack({len(classes)}, {pairs}) AS (class, n)"))


def listing_cards(pages: DataFrame, is_title: Callable[[str], bool], before: int = 3, after: int = 6) -> DataFrame:
    """``page_id, line_no, title, context`` of a listing's cards, greedily: a card uses up the lines around its title.

    What a title uses decides whether a later line can be one, so a page is
    walked in order; pages are independent, and each is one row.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page, text in zip(batch["page_id"], batch["text"]):
                lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
                free, seen = 0, set()
                for i, line in enumerate(lines):
                    if i >= free and line.lower() not in seen and is_title(line):
                        seen.add(line.lower())
                        found.append((page, i, line, " ".join(lines[max(0, i - 2) : i + 9])))
                        free = i + after + 1
            yield pd.DataFrame(found, columns=["page_id", "line_no", "title", "context"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "text").mapInPandas(walk, f"page_id {kind}, line_no int, title string, context string")
