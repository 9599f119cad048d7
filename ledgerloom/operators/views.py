"""Views that pages show: latest, best, archives, filters, sorts, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import buckets
from ledgerloom.functions.versions import natural_key


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; ties must be broken by the order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def top_by_score(rows: DataFrame, key: str, score: Column, newest: list[Column], limit: int = 10) -> DataFrame:
    """The best row of each key (newer wins ties), of these the newest ``limit``."""
    best = latest(rows.withColumn("score", score), key, [F.desc("score"), *newest])
    return best.orderBy(*newest).limit(limit)


def feed_score(featured: Column, archived: Column, published: Column, bonus: Column) -> Column:
    """Additive home score in whole numbers: featured, then not archived, then date and bonus."""
    return (
        F.when(featured, F.lit(10**15)).otherwise(F.lit(0)) + F.when(archived, F.lit(0)).otherwise(F.lit(10**13)) + F.unix_seconds(published.cast("timestamp")) + bonus
    ).cast("long")


def by_year(rows: DataFrame, moment: str, recent: Column) -> DataFrame:
    """Rows of each year that are not recent; undated ones stand apart."""
    year = F.coalesce(F.year(moment).cast("string"), F.lit("undated"))
    return rows.where(~F.coalesce(recent, F.lit(False))).groupBy(year.alias("year")).agg(F.count("*").alias("n"))


def is_recent(moment: str, this_year: int) -> Column:
    """From December of the year before."""
    return F.year(moment) * 100 + F.month(moment) >= (this_year - 1) * 100 + 12


def feed(rows: DataFrame, query: str = "", text: list[str] = (), equal: dict[str, str] | None = None) -> DataFrame:
    """Rows whose fields hold all words of the query and equal the chosen values."""
    joined = F.lower(F.concat_ws(" ", *text)) if text else F.lit("")
    for word in query.lower().split():
        rows = rows.where(F.contains(joined, F.lit(word)))
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == value)
    return rows


def sort_feed(rows: DataFrame, mode: str, company: str, product: str, verdict: str, moment: str, tie: str) -> DataFrame:
    """Feed orders: company, software, risk (worst first, then newest), latest; ``tie`` makes them total."""
    order = {
        "company": [F.lower(company), F.lower(product), F.desc(moment)],
        "software": [F.lower(product), F.desc(moment)],
        "risk": [buckets.verdict_rank(F.col(verdict)), F.desc(moment)],
        "latest": [F.desc(moment)],
    }[mode]
    return rows.orderBy(*order, tie)


def table_order(primary: Column, moment: str, version: str, descending: bool = False) -> list[Column]:
    """By a column in either direction, then newest first, then natural version."""
    return [primary.desc_nulls_last() if descending else primary.asc_nulls_first(), F.desc_nulls_last(moment), natural_key(F.col(version)), F.col(version)]


def sort_table(rows: DataFrame, primary: Column, moment: str, version: str, descending: bool = False) -> DataFrame:
    """A table in the order of :func:`table_order`."""
    return rows.orderBy(*table_order(primary, moment, version, descending))


def orphans(rows: DataFrame, parents: DataFrame, foreign: str, primary: str, rule: str) -> DataFrame:
    """Rows whose foreign key no parent has, as findings of a rule."""
    return rows.join(parents.select(F.col(primary).alias(foreign)).distinct(), foreign, "left_anti").select(F.lit(rule).alias("rule"), F.col(foreign).cast("string").alias("key"))


def findings(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each of several rules, in one scan; rules nobody breaks stand with 0."""
    counted = rows.agg(*[F.count_if(bad).alias(code) for code, bad in rules.items()])
    pairs = ", ".join(f"'{code}', `{code}`" for code in rules)
    return counted.select(F.expr(f"stack({len(rules)}, {pairs}) AS (code, n)"))


def banned_terms(rows: DataFrame, key: str, fields: list[str], terms: tuple[str, ...], exempt: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Fields that hold a banned term, exempt pairs of field and term left out."""
    pairs = [(f, t) for f in fields for t in terms if (f, t) not in exempt]
    hits = F.array_compact(
        F.array(*[F.when(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t)), F.struct(F.lit(f).alias("field"), F.lit(t).alias("term"))) for f, t in pairs])
    )
    return rows.select(key, F.explode(hits).alias("hit")).select(key, "hit.*")


def selected_order(key: str, selected: str, pos: str) -> list[Column]:
    """The selected rows first, then the order of ``pos``."""
    return [(F.col(key) == F.lit(selected)).desc(), F.col(pos)]


def selected_first(rows: DataFrame, key: str, selected: str, pos: str) -> DataFrame:
    return rows.orderBy(*selected_order(key, selected, pos))


def holding(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str) -> DataFrame:
    """Pairs of keys of texts and of the needles that they hold, without a nested loop; empty needles hold nowhere.

    A needle's key is its longest inner word, which is rare in most texts: a
    needle of three words or more is met only by texts that have that word
    (the first and last word may be parts of longer ones). Needles without an
    inner word are met on their first characters, three or fewer. Ids are
    joined first, texts only for the pairs that are left.
    """
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = lambda c: F.regexp_extract_all(c, F.lit(word), F.lit(0))
    asked = needles.where(F.col(needle) != "").select(F.col(needle_key).alias("n_key"), F.col(needle).alias("needle"), words(F.col(needle)).alias("ws"))
    longest = F.array_max(F.transform(F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.withColumn("part", longest).drop("ws")
    rows = texts.select(F.col(key).alias("t_key"), F.col(text).alias("whole"))
    met = rows.select("t_key", F.explode(F.array_distinct(words(F.col("whole")))).alias("part")).join(asked.where("part IS NOT NULL"), "part").select("t_key", "n_key", "needle")
    short = asked.where("part IS NULL").select("n_key", "needle")
    least = short.agg(F.min(F.length("needle"))).first()[0]
    if least:
        n = min(3, least)
        starts = short.withColumn("part", F.substring("needle", 1, n))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("whole") - n + 1, F.lit(1))), lambda i: F.substring(F.col("whole"), i, F.lit(n))))
        met = met.unionByName(rows.select("t_key", F.explode(grams).alias("part")).join(starts, "part").select("t_key", "n_key", "needle"))
    return rows.join(met, "t_key").where(F.contains("whole", F.col("needle"))).select(F.col("t_key").alias(key), F.col("n_key").alias(needle_key)).distinct()


def articles(rows: DataFrame, text: list[str], query: str = "", category: str = "all", categories: str = "categories") -> DataFrame:
    """Articles of a category (``all`` is any) whose fields, joined by spaces, hold the query as one phrase; missing fields are empty."""
    said = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text]))
    wanted = query.lower().strip()
    kept = rows.where(F.contains(said, F.lit(wanted))) if wanted else rows
    return kept if category == "all" else kept.where(F.contains(F.lower(F.coalesce(F.col(categories), F.lit(""))), F.lit(category)))


def lane(status: str = "update_status", hidden: str = "feed_hidden") -> Column:
    """``archived`` by status, ``current`` if neither archived nor hidden, else null; what is not said hides nothing."""
    archived = F.col(status).eqNullSafe(F.lit("archived"))
    return F.when(archived, "archived").when(~F.col(hidden).eqNullSafe(F.lit(True)), "current")


def newest_first(moment: str, pos: str) -> list[Column]:
    """Order of a list that is sorted by a moment and then reversed: undated first, ties in reversed order of their places."""
    return [F.desc_nulls_first(moment), F.desc(pos)]


def given(*choices: Column) -> Column:
    """The first that is neither missing nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])


# Labels that cards show for states of evidence.
EVIDENCE_LABELS = {
    "pilot_sample": "Verified reports", "static_sample": "Verified reports", "official_only": "Official source only", "consensus_live": "Live consensus", "insufficient_data": "Insufficient data",
}


def shown_fields() -> dict[str, Column]:
    """What a card shows of ``update_consensus_label, community_reaction, evidence_state, evidence_state_label``: reaction and its class, state and its label."""
    reaction = given(F.col("update_consensus_label"), F.col("community_reaction"), F.lit("Insufficient"))
    state = F.replace(F.lower(given(F.col("evidence_state"), F.lit("insufficient_data"))), F.lit("-"), F.lit("_"))
    said = F.replace(given(F.col("evidence_state_label"), state), F.lit("_"), F.lit(" "))
    capital = F.concat(F.upper(F.substring(said, 1, 1)), F.lower(F.substring(said, F.lit(2), F.length(said))))
    known = F.create_map(*[F.lit(x) for pair in EVIDENCE_LABELS.items() for x in pair])
    return {
        "reaction": reaction, "reaction_class": F.replace(F.lower(reaction), F.lit(" "), F.lit("-")), "feed_evidence_state": state,
        "feed_evidence_label": F.coalesce(F.try_element_at(known, state), capital),
    }
