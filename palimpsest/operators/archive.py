"""Archive index, reverse reconstruction, verified replay and renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which source of a selectable date wins.
PRECEDENCE = {"version": 1, "change": 2, "observation": 3, "head": 4}


def archive_index(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, day, source): the selectable days of each key, each from the source of highest precedence.

    ``sources``: name in ``PRECEDENCE`` -> (key, day). The head is the last observation.
    """
    parts = [d.select(key, "day", F.lit(PRECEDENCE[name]).alias("rank"), F.lit(name).alias("source")) for name, d in sources.items()]
    if "observation" in sources:
        head = sources["observation"].groupBy(key).agg(F.max("day").alias("day"))
        parts.append(head.select(key, "day", F.lit(PRECEDENCE["head"]).alias("rank"), F.lit("head").alias("source")))
    return reduce(DataFrame.unionByName, parts).where(F.col("day").isNotNull()).groupBy(key, "day").agg(F.max_by("source", "rank").alias("source"))


def same_body(a: Column, b: Column) -> Column:
    """Equal apart from white space."""
    strip = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return strip(a).eqNullSafe(strip(b))


def reverse_reconstruction(changes: DataFrame, heads: DataFrame, target: Column, longest: int | None = None, captured: Column | None = None) -> DataFrame:
    """(act_id, label, body, applied, gaps): the text of each section before all changes later than ``target``.

    ``changes``: act_id, label, day, old_text, new_text; ``heads``: act_id, label, body. Changes are undone from the newest;
    one is undone only if its day has a single wording, both sides are there and neither has exactly ``longest`` characters (the
    mark of a capture cap; a longer side is whole), and its new text is the body so far. ``captured``, on act_id: whose captures had the cap. Any other is a gap and leaves the body as it is. ``gaps`` lists their reasons in order, '' for none.
    """
    later = changes.where(F.col("day") > target).dropDuplicates(["act_id", "label", "day", "old_text", "new_text"])
    per_day = later.groupBy("act_id", "label", "day").agg(F.count("*").alias("n"), F.min(F.struct("old_text", "new_text")).alias("c"))
    steps = per_day.groupBy("act_id", "label").agg(F.reverse(F.array_sort(F.collect_list(F.struct("day", "n", F.col("c.old_text").alias("old_text"), F.col("c.new_text").alias("new_text"))))).alias("steps"))
    start = F.struct(F.col("body").alias("body"), F.lit(0).alias("applied"), F.array().cast("array<string>").alias("gaps"))

    def reason(acc: Column, s: Column) -> Column:
        empty = F.coalesce(F.trim(s["old_text"]), F.lit("")).eqNullSafe("") | F.coalesce(F.trim(s["new_text"]), F.lit("")).eqNullSafe("")
        capped = F.lit(False) if longest is None else (F.length(s["old_text"]) == longest) | (F.length(s["new_text"]) == longest)
        capped = capped if captured is None else capped & captured
        return (
            F.when(s["n"] > 1, "ambiguous_transition").when(empty, "empty_change_side").when(capped, "truncated_side").when(~same_body(acc["body"], s["new_text"]), "state_mismatch")
        )

    def undo(acc: Column, s: Column) -> Column:
        why = reason(acc, s)
        return F.struct(
            F.when(why.isNull(), s["old_text"]).otherwise(acc["body"]).alias("body"),
            (acc["applied"] + why.isNull().cast("int")).alias("applied"),
            F.when(why.isNull(), acc["gaps"]).otherwise(F.concat(acc["gaps"], F.array(why))).alias("gaps"),
        )

    joined = heads.join(steps, ["act_id", "label"], "left")
    result = F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, undo))
    return joined.select("act_id", "label", result.alias("r")).select("act_id", "label", F.col("r.body").alias("body"), F.col("r.applied").alias("applied"), F.array_join("r.gaps", ",").alias("gaps"))


def occurrences(text: Column, needle: Column) -> Column:
    """How often a literal needle occurs in a text."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def verified_replay(rows: DataFrame, text: str, old: str, new: str, digest: str) -> DataFrame:
    """Undo one literal replacement and accept the result only if doing it again gives the anchored digest.

    Adds ``before`` (null unless verified) and ``verdict``: 'verified', 'not_unique' (the new wording is not there exactly
    once), 'old_not_unique' (the forward command would be ambiguous) or 'digest_mismatch'.
    """
    undone = F.replace(F.col(text), F.col(new), F.col(old))
    redone = F.replace(undone, F.col(old), F.col(new))
    verdict = (
        F.when(F.coalesce(occurrences(F.col(text), F.col(new)), F.lit(0)) != 1, "not_unique")
        .when(occurrences(undone, F.col(old)) != 1, "old_not_unique")
        .when(F.sha2(redone, 256) != F.col(digest), "digest_mismatch")
        .otherwise("verified")
    )
    return rows.withColumn("verdict", verdict).withColumn("before", F.when(F.col("verdict") == "verified", undone))


def render(candidates: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, body, source, exact): the first candidate with a body in the given order; reconstructions are not exact."""
    order = {name: i for i, name in enumerate(candidates)}
    parts = [d.select(*keys, "body", F.lit(order[n]).alias("rank"), F.lit(n).alias("source")) for n, d in candidates.items()]
    best = reduce(DataFrame.unionByName, parts).where(F.col("body").isNotNull()).groupBy(*keys).agg(F.min_by(F.struct("body", "source"), "rank").alias("b"))
    return best.select(*keys, F.col("b.body").alias("body"), F.col("b.source").alias("source"), (F.col("b.source") != "reconstruction").alias("exact"))


def markdown(sections: DataFrame, key: str, order: str, heading: str, body: str) -> DataFrame:
    """(key, markdown): front matter and the sections in order."""
    line = F.concat(F.lit("## "), F.col(heading), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")))
    parts = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("s"))
    return parts.select(key, F.concat(F.lit("---\nact: "), F.col(key), F.lit("\nsections: "), F.size("s").cast("string"), F.lit("\n---\n\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")).alias("markdown"))


def xml_text(value: Column) -> Column:
    """Text with the five XML characters escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def atom_entries(rows: DataFrame, ident: str, title: str, updated: str) -> DataFrame:
    """Rows with ``entry``, an Atom 1.0 entry."""
    entry = F.concat(F.lit("<entry><id>"), xml_text(F.col(ident)), F.lit("</id><title>"), xml_text(F.col(title)), F.lit("</title><updated>"), F.col(updated), F.lit("</updated></entry>"))
    return rows.withColumn("entry", entry)


def blame(changes: DataFrame, keys: list[str], day: str, target: Column) -> DataFrame:
    """The last change of each section on or before a day (who wrote what stands there)."""
    return changes.where(F.col(day) <= target).groupBy(*keys).agg(F.max_by("change_id", F.struct(F.col(day), F.col("change_id"))).alias("change_id"), F.max(day).alias("since"))


def log(changes: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Changes numbered per section from the newest."""
    return changes.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day), F.desc("change_id"))))
