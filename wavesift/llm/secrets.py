"""Secret scans in DataFrame functions only: base patterns, and weak parts of credentials that
count when parts that complete each other stand within reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import hide

#: kind: pattern, the group whose length counts, its least length. Fixed values of the base scan.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Weak parts, kind: role, pattern, group, least length. Alone none of them is reported.
WEAK = {
    "id": ("id", r"""(?i:\b(?:client_?id|access_?id|key_?id|account|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 3),
    "key": ("secret", r"""(?i:\b(?:client_key|private_key|access_key|pass|pwd|auth|credential|signature|key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "blob": ("secret", r"[A-Za-z0-9+/]{40,}={0,2}", 0, 40),
    "endpoint": ("endpoint", r"""(?:(?i:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?i:\b(?:host|endpoint|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+)""", 0, 6),
}
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {k: v[0] for k, v in WEAK.items()}
ORDER = [*BASE, *WEAK]
#: A text without a match of this has no weak part; most texts end here.
HINT = r"[:=]|[A-Za-z0-9+/]{40}"
SPAN = "array<struct<start:int,stop:int,rank:int,kind:string>>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, stop in code points, rank, kind) of the leftmost non-overlapping matches
    whose group has `least` code points or more.

    Spark gives no places of all matches, but what stands between them: the lengths of the
    parts that split() leaves and of the matches add up to their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
    sizes = F.transform(found, F.length)
    long = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
    spans = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), long.alias("long")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(
                x["long"] >= least,
                F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("stop"), F.lit(ORDER.index(kind)).alias("rank"), F.lit(kind).alias("kind")))),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:stop of spans, comma-joined, in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def linked_parts(parts: DataFrame, reach: int) -> DataFrame:
    """Of parts (row, start, stop, rank, kind, role), the weak ones that have, within `reach`
    code points of the same text, a part of another role.

    An interval join: each part is put under the scopes of `reach` code points that it
    touches when widened by `reach`, so two parts within reach meet in a scope; the equal join
    on row and scope is cut down to real neighbours. A scope holds no more parts than code
    points allow, so the join grows with the text and not with the square of its parts.
    """
    scope = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    weak = parts.where(F.col("kind").isin(*WEAK))
    a = weak.withColumn("scope", scope(F.greatest(F.col("start") - reach, F.lit(0)), F.col("stop") + reach - 1))
    b = parts.select(F.col("row").alias("row_b"), F.col("start").alias("start_b"), F.col("stop").alias("stop_b"), F.col("role").alias("role_b"))
    b = b.withColumn("scope_b", scope(F.col("start_b"), F.col("stop_b") - 1))
    near = (F.col("start_b") < F.col("stop") + reach) & (F.col("start") < F.col("stop_b") + reach)
    apart = (F.col("stop_b") <= F.col("start")) | (F.col("stop") <= F.col("start_b"))
    on = (F.col("row") == F.col("row_b")) & (F.col("scope") == F.col("scope_b")) & near & apart & (F.col("role") != F.col("role_b"))
    return a.join(b, on, "left_semi").select("row", "start", "stop", "rank", "kind").distinct()


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """docs with `spans`: array of (start, stop, rank, kind) by start, then kind as listed.

    Base spans are always there. A weak one (an identifier, a key, a blob, an endpoint) is
    there when a part of another role stands within `reach` code points and isn't under it;
    base spans count as such parts, and a weak part under a base span is no part. Null and
    empty texts have no spans; repeated rows have the same. Rows are told apart by 128 bits of
    hash of id and text. A column named spans is replaced, others stay, whatever their names.
    """
    names = docs.columns
    docs, own = hide(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.flatten(F.array(*[matches(text, k, *v) for k, v in BASE.items()])))
    out = docs.withColumn("_base", base).withColumn("_key", F.concat_ws(":", F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))))
    weak = F.flatten(F.array(*[matches(text, k, *v[1:]) for k, v in WEAK.items()]))
    free = F.filter(weak, lambda w: ~F.exists(F.col("_base"), lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    held = out.where(F.regexp_like(text, F.lit(HINT))).select(F.col("_key").alias("row"), F.concat("_base", free).alias("all"))
    kinds = F.array_distinct(F.transform("all", lambda s: role[s["kind"]]))
    held = held.where(F.exists("all", lambda s: s["rank"] >= len(BASE)) & (F.size(kinds) > 1)).dropDuplicates(["row"])
    parts = held.select("row", F.explode("all").alias("s")).select("row", "s.*", role[F.col("s.kind")].alias("role"))
    links = linked_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "stop", "rank", "kind")).alias("_more"))
    joined = out.join(links.withColumnRenamed("row", "_row"), F.col("_key") == F.col("_row"), "left")
    both = F.concat(F.col("_base"), F.coalesce(F.col("_more"), F.array().cast(SPAN)))
    spans = F.array_sort(both, lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["rank"] - y["rank"])).cast("int"))
    stay = [(o, n) for o, n in zip(own, names, strict=True) if n != "spans"]
    return joined.withColumn("spans", spans).select(*[o for o, _ in stay], "spans").toDF(*[n for _, n in stay], "spans")


def redact(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with every span of its texts replaced by mark, overlapping ones by one mark; all
    columns as they are, but n_chars, where there is one, is the new length of a changed text."""
    own, names = hide(docs, ("doc_id", "text", "n_chars"))
    found = scan(own, **how)
    state = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"))
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text") - s["at"])),
    )
    out = found.withColumn("_text", F.when(F.size("spans") > 0, state).otherwise(F.col("text")))
    new = {"text": F.col("_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in names]).toDF(*docs.columns)
