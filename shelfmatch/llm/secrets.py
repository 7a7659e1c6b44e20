"""Secret scans with multipart credential linking (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm.common import saved, table, text_or_empty

#: The base kinds in their order, pattern, and least length of what counts.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]{16,}", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: Weak parts: an identifier or an endpoint alone is no secret, a long mixed string may be anything. Names may
#: follow an underscore (``DB_HOST=``), the user of an address is an identifier, a value may follow ``=``.
WEAK = {
    "identifier": (
        r"(?i)(?<![A-Za-z0-9])(?:access_?key_?id|key_?id|client_?id|account_?id|tenant_?id|user_?name|login)"
        r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
        r"""|(?<=://)[^\s"'<>:/@?#]+(?=:(?!\d{1,5}[/?#])[^\s"'<>@]+@)"""
    ),
    "endpoint": (
        r"""(?i)(?<![A-Za-z0-9])(?:(?:https?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
        r"""|(?:host|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?)"""
    ),
    "candidate": (
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
        r"[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
    ),
}
KINDS = [*BASE, *WEAK]
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Places of the leftmost non-overlapping matches, in code points, end exclusive.

    What stands between matches and the matches themselves, taken in turn, add up to places.
    """
    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        value = F.regexp_extract(x["match"], pattern, group) if group else x["match"]
        good = x["match"].isNotNull() & (F.length(value) >= least)
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["all"], one)).otherwise(state["all"]).alias("all"))

    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("all"))
    found = F.aggregate(pieces, start, step)["all"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def linked(parts: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """Weak parts with their complement in scope: an interval join on keys and bins of ``scope``.

    ``parts`` has keys, ``start``, ``kind``, ``end``. Two parts are in one scope if at most ``scope``
    code points lie between them. An identifier needs a secret, a candidate needs an identifier or
    access key, an endpoint needs both, beside it or inside it. Each weak part meets the parts of its
    own bins and the next on either side, whose number the width of a bin bounds.
    """
    first, last = F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)
    weak = parts.where(F.col("kind") >= len(BASE)).select(
        *keys, "start", "kind", "end", F.explode(F.sequence(first - 1, last + 1)).alias("__bin")
    )
    others = parts.select(
        *keys, F.col("start").alias("__s"), F.col("kind").alias("__k"), F.col("end").alias("__e"),
        F.explode(F.sequence(first, last)).alias("__bin"),
    )
    near = (F.col("__s") <= F.col("end") + scope) & (F.col("__e") >= F.col("start") - scope)
    apart = (F.col("__s") >= F.col("end")) | (F.col("__e") <= F.col("start")) | (F.col("kind") == KINDS.index("endpoint"))
    is_id = F.col("__k").isin(KINDS.index("access"), KINDS.index("identifier"))
    is_secret = F.col("__k").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("candidate"))
    found = weak.join(others, [*keys, "__bin"]).where(near & apart).groupBy(*keys, "start", "kind", "end").agg(
        F.bool_or(is_id).alias("__has_id"), F.bool_or(is_secret).alias("__has_secret")
    )
    kind = F.col("kind")
    enough = (
        F.when(kind == KINDS.index("identifier"), F.col("__has_secret"))
        .when(kind == KINDS.index("candidate"), F.col("__has_id"))
        .otherwise(F.col("__has_id") & F.col("__has_secret"))
    )
    return found.where(enough).select(*keys, "start", "kind", "end")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """Secrets of every whole text: ``doc_id``, ``base`` and ``spans``, sorted arrays of (start, kind, end).

    ``base`` holds the three base kinds; ``spans`` adds the weak parts that their complement backs
    (``linked``). Weak parts that overlap a base span are left out, but for endpoints around it, as are
    candidates that overlap an identifier. Parts inside an endpoint count beside it, so their spans
    lie inside its span. ``kind`` is a place in KINDS. Null texts count as empty; identifiers may be null; rows that
    repeat identifier and text get the same answer each. Other columns are not read.
    """
    keys = ["__null", "__id", "__hash"]
    kind_of = df.schema[id_col].dataType
    text = F.col("__text")
    rows = df.select(
        F.col(id_col).isNull().alias("__null"), F.coalesce(F.col(id_col), F.lit(0).cast(kind_of)).alias("__id"),
        F.xxhash64(text_col).alias("__hash"), text_or_empty(text_col).alias("__text"),
    ).select(
        *keys,
        F.concat(*[spans(text, p, KINDS.index(k), g, n) for k, (p, g, n) in BASE.items()]).alias("__base"),
        F.concat(*[spans(text, p, KINDS.index(k)) for k, p in WEAK.items() if k != "candidate"]).alias("__named"),
        spans(text, WEAK["candidate"], KINDS.index("candidate")).alias("__mixed"),
    )

    endpoint = KINDS.index("endpoint")

    def clear(some: str, of: list[str]) -> Column:
        hit = lambda x, y: (y["start"] < x["end"]) & (y["end"] > x["start"])
        around = lambda x, y: (x["kind"] == endpoint) & (y["start"] >= x["start"]) & (y["end"] <= x["end"])
        own = lambda x, y: (y["kind"] == endpoint) | around(x, y)
        return F.filter(some, lambda x: ~F.exists(F.concat(*of), lambda y: hit(x, y) & ~own(x, y)))

    rows = saved(
        rows.withColumn("__mixed", clear("__mixed", ["__base", "__named"]))
        .withColumn("__named", clear("__named", ["__base"]))
        .select(*keys, "__base", F.concat("__named", "__mixed").alias("__weak"))
    )
    parts = rows.where(F.size("__weak") > 0).select(
        *keys, F.explode(F.concat("__base", "__weak")).alias("__part")
    ).select(*keys, "__part.*").distinct()
    extra = linked(parts, keys, scope).groupBy(*keys).agg(F.collect_list(F.struct("start", "kind", "end")).alias("__extra"))
    none = F.array().cast(SPAN)
    return rows.join(extra, keys, "left").select(
        F.when(~F.col("__null"), F.col("__id")).alias("doc_id"),
        F.sort_array("__base").alias("base"),
        F.sort_array(F.concat("__base", F.coalesce("__extra", none))).alias("spans"),
    )


def written(found: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string")
    )), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )
