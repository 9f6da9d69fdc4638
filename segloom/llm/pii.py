"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are those of four patterns, leftmost and non-overlapping by kind, that pass the kind's test. They are the seeds of a graph
between lexical patterns and instances:

- An instance is a base span; or a word that holds an ``@`` between letters or digits, or three digits or more in six characters, less the
  punctuation around it and the cue in front; or a run of groups of digits with single spaces between them.
- A lexical pattern is the word before an instance (L), the two words before (L2), the word after (R), the two after (R2), the word before and
  the word after an instance of one word (S, a slot), or the cue glued to its front up to ``=`` or ``:`` (P). Case does not count.
- A pattern's confidence for a kind is the sum of its instances' scores for the kind over the number of times that its words, slot or cue occur
  in the corpus at all, with an instance or without; it counts if at least ``SUPPORT`` different instances bear it out and it reaches ``SURE``.
- An instance's score for a kind is 1 if it is a base span of the kind somewhere, else that of its surest pattern.

Both are computed in turn for ``ROUNDS`` rounds; then instances that reach ``SURE`` become spans of their best kind (of equal ones, the last by
name), wherever they stand, unless they overlap a base span; a word inside a run that became a span does not. Base spans are never dropped.

Only patterns with ``SUPPORT`` different instances are counted in the corpus, whose words are met by them where they stand (a broadcast, if Spark
finds the table small, else a join), and summed up before they move.

The pattern strings below use possessive loops, look-behind and anchors so that matching takes linear time and no stack; they match
what the plain patterns match. Gaps and matches of one left-to-right scan give the places in code points.

A null text counts as empty. Very long texts and words are scanned whole. Null ids and repeated rows each get their row. Extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import quoted

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, SURE = 3, 5, 0.6
#: Characters of a gap that mostly hold the two words next to a match; where they do not, the whole gap is kept.
NEAR = 80
_BLANK = r"\x20\x09-\x0D"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![^{_BLANK}])[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+",
    "run": rf"(?<![^{_BLANK}])[0-9+(][0-9().+-]*+(?:\x20[0-9(][0-9().-]*+)++(?![^{_BLANK}.,;:!?])",
}
#: A text without this has no match; cheaper than the pattern.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": r"[0-9@]", "run": r"[0-9().+-]\x20[0-9(]"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    each = F.split(F.reverse(digits), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2).cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(each, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    """Whether a match of a kind's pattern passes its test."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    d = _digits(m)
    n = F.length(d)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", m.rlike(rf"\A{part}(?:\.{part}){{3}}\z"))
        .when(kind == "card", F.when(n.between(12, 19), luhn(d)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


#: Two whole words from the edge of a gap on, the rest of a word that touches the match left out; on the left, read backwards.
_TWO_WORDS = rf"\A[^{_BLANK}]*+[{_BLANK}]++[^{_BLANK}]++[{_BLANK}]++[^{_BLANK}]++[{_BLANK}]"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: rid, doc_id, and by kind the matches with their gap's length and the text around; null if none."""
    text = F.col("__text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("__text"))
    cut = rows.select(
        "rid", "doc_id",
        *(F.when(text.rlike(_NEEDS[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p in PATTERNS.items()),
        *(F.when(text.rlike(_NEEDS[k]), F.split(text, p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()),
    )
    return cut.select("rid", "doc_id", *(F.when(F.size(f"m_{k}") > 0, _around(F.col(f"m_{k}"), F.col(f"g_{k}"))).alias(k) for k in PATTERNS))


def _around(matches: Column, gaps: Column) -> Column:
    """Each match with the length of the gap before it and the text on both sides: the gap, and the next two matches with theirs."""
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    near = lambda cut, whole, back: F.when(F.length(whole) <= NEAR, whole).when((F.reverse(cut) if back else cut).rlike(_TWO_WORDS), cut).otherwise(whole)

    def one(m: Column, i: Column) -> Column:
        left = F.concat(at(matches, i - 2), F.when(i > 0, at(gaps, i - 1)).otherwise(""), at(matches, i - 1), at(gaps, i))
        right = F.concat(at(gaps, i + 1), at(matches, i + 1), F.when(i + 2 < F.size(gaps), at(gaps, i + 2)).otherwise(""), at(matches, i + 2))
        return F.struct(m.alias("m"), F.length(at(gaps, i)).alias("gap"), near(F.right(left, F.lit(NEAR)), left, True).alias("left"), near(F.left(right, F.lit(NEAR)), right, False).alias("right"))

    return F.transform(matches, one)


def places(scanned: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """rid, kind, start, end, m, left, right of every match."""
    parts = [scanned.where(F.col(k).isNotNull()).select("rid", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "x")) for k in kinds]
    rows = reduce(DataFrame.unionByName, parts).select("rid", "kind", "i", "x.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("m")).drop("i", "gap")


#: A cue at the front of a word.
_CUE = r"\A[^A-Za-z0-9]*+([A-Za-z_.-]++[=:])"
#: What counts the occurrences of a side's patterns: words, pairs, pairs around a word, cues.
_COUNTED = {"L": "U", "R": "U", "L2": "B", "R2": "B", "S": "S", "P": "P"}


def _trimmed(rows: DataFrame) -> DataFrame:
    """Words and runs as instances (item): the cue and punctuation in front join what stands on the left, punctuation behind the right."""
    prefix = F.regexp_extract("m", r"\A[^A-Za-z0-9]*+(?:[A-Za-z_.-]++[=:][^A-Za-z0-9]*+)?", 0)
    behind = F.reverse(F.regexp_extract(F.reverse("m"), r"\A[^A-Za-z0-9]*+", 0))
    got = rows.withColumn("__p", prefix).withColumn("__b", F.when(F.length(prefix) < F.length("m"), behind).otherwise(""))
    got = got.withColumn("item", F.substr("m", F.length("__p") + 1, F.length("m") - F.length("__p") - F.length("__b")))
    got = got.withColumn("left", F.concat("left", "__p")).withColumn("right", F.concat("__b", "right"))
    return got.withColumn("start", F.col("start") + F.length("__p")).withColumn("end", F.col("end") - F.length("__b")).drop("__p", "__b", "m")


def _contexts(rows: DataFrame) -> DataFrame:
    """rows with item, left, right: item, side, w of their patterns, one row each."""
    back, ahead = F.reverse(F.lower("left")), F.lower("right")
    two = rf"\A[^{_BLANK}]*+[{_BLANK}]++([^{_BLANK}]++)(?:[{_BLANK}]++([^{_BLANK}]++))?"
    l1, l2 = (F.reverse(F.regexp_extract(back, two, g)) for g in (1, 2))
    r1, r2 = (F.regexp_extract(ahead, two, g) for g in (1, 2))
    glued = F.reverse(F.regexp_extract(back, rf"\A[^{_BLANK}]*+", 0))
    cue = F.regexp_extract(glued, _CUE + r"[^A-Za-z0-9]*+\z", 1)
    named = rows.select("item", l1.alias("l1"), l2.alias("l2"), r1.alias("r1"), r2.alias("r2"), cue.alias("cue"))
    both = lambda a, b: F.when((F.col(a) != "") & (F.col(b) != ""), F.concat(F.col(a), F.lit(" "), F.col(b))).otherwise("")
    single = ~F.col("item").rlike(f"[{_BLANK}]")
    sides = {"L": F.col("l1"), "L2": both("l2", "l1"), "R": F.col("r1"), "R2": both("r1", "r2"), "S": F.when(single, both("l1", "r1")).otherwise(""), "P": F.col("cue")}
    each = F.array(*(F.struct(F.lit(k).alias("side"), v.alias("w")) for k, v in sides.items()))
    return named.select("item", F.explode(each).alias("c")).select("item", "c.side", "c.w").where("w <> ''")


def occurrences(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """counted, w, occurs: how often words (U), pairs (B), pairs around a word (S) and cues (P) of ``wanted`` (counted, w) occur."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(quoted(text_col)), F.lit(""))), rf"[{_BLANK}]++"), lambda w: w != "")
    ws = docs.select(words.alias("ws"))
    pair = lambda w, i, k: F.concat(w, F.lit(" "), F.get("ws", i + k))
    keys = F.transform("ws", lambda w, i: F.array(F.struct(F.lit("U").alias("counted"), w.alias("w")), F.struct(F.lit("B").alias("counted"), pair(w, i, 1).alias("w")),
                                                  F.struct(F.lit("S").alias("counted"), pair(w, i, 2).alias("w")), F.struct(F.lit("P").alias("counted"), F.when(w.rlike("[=:]"), F.regexp_extract(w, _CUE, 1)).alias("w"))))
    every = ws.select(F.explode(F.flatten(keys)).alias("k")).select("k.counted", "k.w").where("w is not null and w <> ''")
    return every.join(wanted, ["counted", "w"], "left_semi").groupBy("counted", "w").agg(F.count("*").alias("occurs"))


def _instances(scanned: DataFrame) -> DataFrame:
    """rid, kind (null for words and runs), run, start, end, item, left, right: base spans, and what overlaps none of them."""
    columns = ["rid", "kind", "run", "start", "end", "item", "left", "right"]
    base = places(scanned, KINDS).where(valid(F.col("kind"), F.col("m"))).withColumn("run", F.lit(False)).withColumnRenamed("m", "item")
    found = _trimmed(places(scanned, ("token", "run")))
    n = F.length(_digits(F.col("item")))
    is_run = F.col("kind") == "run"
    word = ((F.length("item") >= 6) & (n >= 3)) | F.col("item").rlike("[A-Za-z0-9]@[A-Za-z0-9]")
    other = found.where(F.when(is_run, (n >= 7) & F.contains("item", F.lit(" "))).otherwise(word)).withColumn("run", is_run).withColumn("kind", F.lit(None).cast("string"))
    # one pass by document: what begins before an instance and ends after its start covers it
    both = base.select(*columns).unionByName(other.select(*columns))
    at = Window.partitionBy("rid").orderBy("start", F.col("kind").isNull(), "end")
    is_base, none = F.col("kind").isNotNull(), F.lit(1 << 62)
    reach = F.max(F.when(is_base, F.col("end")).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(is_base, F.col("start")).otherwise(none)).over(at.rowsBetween(0, Window.unboundedFollowing))
    marked = both.withColumn("__r", reach).withColumn("__n", following)
    return marked.where(is_base | ((F.col("__r") <= F.col("start")) & (F.col("__n") >= F.col("end")))).select(*columns)


def scores(found: DataFrame, docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """item, kind, score after the last round. found: ``_instances``, written."""
    counted = F.element_at(F.create_map(*(F.lit(x) for kv in _COUNTED.items() for x in kv)), F.col("side"))
    edges = scratch.write(_contexts(found).groupBy("side", "w", "item").agg(F.count("*").alias("n")))
    wanted = scratch.write(edges.groupBy("side", "w").agg(F.count("*").alias("items")).where(F.col("items") >= SUPPORT).select("side", counted.alias("counted"), "w"))
    occurs = scratch.write(occurrences(docs, text_col, wanted.select("counted", "w").distinct()))
    graph = scratch.write(edges.join(wanted.join(occurs, ["counted", "w"]).drop("counted"), ["side", "w"]))
    scratch.drop(edges)
    sure = scratch.write(found.where("kind is not null").select("item", "kind").distinct().withColumn("score", F.lit(1.0)))
    now = sure
    for _ in range(ROUNDS):
        pattern = (
            graph.join(now, "item")
            .groupBy("side", "w", "kind")
            .agg(F.least(F.sum(F.col("n") * F.col("score")) / F.first("occurs"), F.lit(1.0)).alias("conf"), F.count("*").alias("support"))
            .where((F.col("support") >= SUPPORT) & (F.col("conf") >= SURE))
        )
        reached = graph.join(pattern, ["side", "w"]).groupBy("item", "kind").agg(F.max("conf").alias("score"))
        now = scratch.write(sure.unionByName(reached).groupBy("item", "kind").agg(F.max("score").alias("score")))
    return now


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (spans that the contexts added)."""
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.write(scan(docs, id_col, text_col))
    found = scratch.write(_instances(scanned))
    best = scores(found, docs, text_col, scratch).groupBy("item").agg(F.max(F.struct("score", "kind")).alias("b")).select("item", F.col("b.kind").alias("kind"))
    base, other = found.where("kind is not null"), found.where("kind is null").drop("kind")
    added = other.join(best, "item").select("rid", "kind", "run", "start", "end")
    at = Window.partitionBy("rid").orderBy("start", F.desc("run")).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("run"), F.col("end")).otherwise(0)).over(at) > F.col("start")
    added = added.withColumn("__in", inside & ~F.col("run")).where("not __in").select("rid", "kind", "start", "end", F.lit(False).alias("base"))
    order = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    spans = base.select("rid", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added).withColumn("ord", order)
    listed = spans.groupBy("rid").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS),
        F.count(F.when(~F.col("base"), 1)).alias("n_found"),
        F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "base"))).alias("list"),
    )
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = scanned.select("rid", "doc_id").join(listed, "rid", "left").withColumn("list", F.coalesce("list", F.expr("array()").cast(listed.schema["list"].dataType)))
    return out.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(join(F.filter("list", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), join(F.col("list")).alias("spans"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
    )
