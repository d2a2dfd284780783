"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

The benchmark is cut into windows of consecutive words. The corpus counts of its words tell the two
rarest of every window; the index stores the postings (document, position) of those rare words, and
under the empty word the length of every document. A posting minus the word's place in its item is an
alignment of the item with the document. The lists of a window's two rarest words are intersected on
equal alignments, which leaves few candidates beside true occurrences, and these are compared word by
word with the whole text (``slop=0``).

With ``slop>0`` a window of n words occurs where n + 2 * ``slop`` consecutive words of the document hold all
its words, in any order, each as often as the window does. Alignments say nothing then: the lists are
intersected on positions less than that width apart, and every start in their reach is tried. Hit words are
those of the tightest spans, which hold the window and in which no shorter span does.

The benchmark's side of a join is broadcast only if its counted rows stay below a bound, and is shuffled
otherwise; a list is collected only for one window, one alignment or one document.

Defined results: null and empty texts have no words and are never hit; a document is told from others by
its id and text, so that repeated rows get one result each and a null id is an id of its own; items
without words match nothing, items of equal text are matched once and counted each; an empty benchmark
leaves all documents clean. Only ``doc_id``/``text`` and ``item_id``/``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.session import cut_lineage

WINDOW = 10
#: Rows up to which a counted table is broadcast (below 100 bytes each).
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Lower-case A-Z, then the maximal runs of other-than-ASCII-punctuation; null gives no words."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lower = F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _BREAK), "")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_h"), words("text").alias("_w"))


def distinct_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct item texts with their words, and (item, item_id) for every benchmark row."""
    rows = benchmark.select("item_id", words("text").alias("item_words")).where(F.size("item_words") > 0)
    rows = cut_lineage(rows.withColumn("item", F.sha2(F.array_join("item_words", " "), 256)))
    return rows.groupBy("item").agg(F.first("item_words").alias("item_words")), rows.select("item", "item_id").distinct()


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """How often each term occurs in the corpus; terms that never occur are absent."""
    found = docs.select(F.explode(words("text")).alias("term"))
    if n_terms <= BROADCAST_ROWS:
        return found.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def _tight_spans(text: str, c: Column, slop: int) -> Column:
    """The tightest spans [s, e) of at most len + 2 * slop words that hold the candidate's words, from its first to its last start."""
    need = F.transform(F.array_distinct(c["w"]), lambda x: F.struct(x.alias("term"), F.size(F.filter(c["w"], lambda y: y == x)).alias("n")))

    def from_start(t: Column) -> Column:
        part = F.slice(text, t + 1, c["len"] + 2 * slop)
        places = F.transform(part, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        # where each word has come as often as it must; null if it has not
        reach = F.transform(need, lambda x: F.get(F.filter(places, lambda y: y["v"] == x["term"]), x["n"] - 1)["i"])
        return F.struct(t.alias("s"), F.when(~F.exists(reach, lambda r: r.isNull()), t + F.array_max(reach) + 1).alias("e"))

    first = lambda s: F.get(text, s["s"])
    times = lambda words, word: F.size(F.filter(words, lambda y: y == word))
    starts = F.filter(F.sequence(c["s"], c["t"]), lambda t: F.array_contains(c["w"], F.get(text, t)))
    held = F.filter(F.transform(starts, from_start), lambda s: s["e"].isNotNull())
    return F.filter(held, lambda s: times(F.slice(text, s["s"] + 1, s["e"] - s["s"]), first(s)) == times(c["w"], first(s)))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: n_words, n_hit, and the sorted ids of the items with an occurring window."""
    items, ids = distinct_items(benchmark)
    terms = cut_lineage(items.select(F.explode("item_words").alias("term")).distinct())
    counts = cut_lineage(term_counts(docs, terms, terms.count()))

    # the two rarest places of every window; a window with a word that never occurs is dropped
    size = F.least(F.lit(window), F.size("item_words"))
    cells = (
        items.select("item", "item_words", size.alias("len"), F.explode(F.sequence(F.lit(0), F.size("item_words") - size)).alias("o"))
        .select("item", "item_words", "len", "o", F.explode(F.sequence(F.col("o"), F.col("o") + F.col("len") - 1)).alias("p"))
        .select("item", "len", "o", "p", F.element_at("item_words", F.col("p") + 1).alias("term"))
        .join(counts, "term")
    )
    windows = (
        cells.groupBy("item", "o", "len").agg(F.sort_array(F.collect_list(F.struct("n", "p", "term"))).alias("_x")).where(F.size("_x") == F.col("len"))
        .select("item", "o", "len", F.col("_x")[0]["p"].alias("a"), F.element_at("_x", F.least(F.lit(2), "len"))["p"].alias("b"), F.slice("_x", 1, 2).alias("_x"))
    )
    windows = cut_lineage(windows)
    anchors = cut_lineage(windows.select("item", "len", F.explode("_x").alias("_x")).select(F.col("_x.term").alias("term"), "item", "len", F.col("_x.p").alias("p")).distinct())
    n_anchors, n_windows = anchors.count(), windows.count()

    # the index: postings of the rare words, and each document's length under the empty word
    rare = anchors.select("term").distinct().union(docs.sparkSession.createDataFrame([("",)], "term string"))
    index = cut_lineage(
        _keyed(docs).select("doc_id", "_h", F.posexplode(F.array_append("_w", F.lit(""))).alias("pos", "term")).join(_sized(rare, n_anchors), "term")
    )
    lengths = index.where("term = ''").select("doc_id", "_h", F.col("pos").cast("long").alias("n_words"))

    # offset-adjusted lists, intersected per alignment; with slop, lists of places in blocks of twice the reach
    lists = index.where("term <> ''").join(_sized(anchors, n_anchors), "term")
    if slop:
        block = F.floor(F.col("pos") / (F.col("len") + 2 * slop))
        lists = lists.select("doc_id", "_h", "item", "p", F.col("pos").alias("at"), F.explode(F.array(block, block + 1)).alias("_c"))
    else:
        lists = lists.select("doc_id", "_h", "item", "p", (F.col("pos") - F.col("p")).alias("at")).withColumn("_c", F.col("at"))
    met = lists.groupBy("doc_id", "_h", "item", "_c").agg(F.collect_set("p").alias("_p"), F.min("at").alias("at"), *([F.max("at").alias("to")] if slop else []))
    per_item = windows.groupBy("item").agg(F.collect_list(F.struct("o", "len", "a", "b")).alias("_windows")).join(items, "item")
    single = F.size("_p") == 1
    if slop:  # the first and last place at which a span with both anchors may start
        place = lambda w: [F.greatest(F.col("at") - w["len"] - 2 * slop + 1, F.lit(0)).alias("s"), F.col("to").alias("t")]
    else:
        place = lambda w: [(w["o"] + F.col("at")).alias("s")]
    open_ = (
        met.join(_sized(per_item, n_windows), "item")
        .withColumn("_open", F.filter("_windows", lambda w: F.array_contains("_p", w["a"]) & F.array_contains("_p", w["b"])))
        .where((F.size("_open") > 0) & (~single | F.exists("_windows", lambda w: w["len"] == 1)))
        .select("doc_id", "_h", "item", F.transform("_open", lambda w: F.struct(*place(w), w["len"].alias("len"), F.slice("item_words", w["o"] + 1, w["len"]).alias("w"))).alias("_open"))
    )
    cands = cut_lineage(
        open_.select("doc_id", "_h", F.explode(F.transform("_open", lambda w: w.withField("item", F.col("item")))).alias("_c"))
        .groupBy("doc_id", "_h").agg(F.collect_set("_c").alias("_cands"))
    )

    # exact check against the whole texts of the candidates' documents
    hot = cands.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"))
    left = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    left = left.join(_sized(hot, cands.count()), left["doc_id"].eqNullSafe(hot["_id"]) & (left["_h"] == hot["_k"]), "left_semi").distinct()
    right = cands.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), "_cands")
    both = left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["_h"] == right["_k"])).select("doc_id", "_h", words("text").alias("_w"), "_cands")
    if slop:
        checked = F.transform("_cands", lambda c: F.struct(c["item"].alias("item"), _tight_spans("_w", c, slop).alias("_spans")))
        checked = F.filter(checked, lambda c: F.size(c["_spans"]) > 0)
        spans = F.flatten(F.transform("_hits", lambda c: c["_spans"]))
    else:
        checked = F.filter("_cands", lambda c: (c["s"] >= 0) & (F.slice("_w", F.greatest(c["s"] + 1, F.lit(1)), c["len"]) == c["w"]))
        spans = F.transform("_hits", lambda c: F.struct(F.greatest(c["s"], F.lit(0)).alias("s"), F.least(c["s"] + c["len"], F.col("_n")).alias("e")))
    hits = cut_lineage(both.select("doc_id", "_h", F.size("_w").alias("_n"), checked.alias("_hits")).where(F.size("_hits") > 0))
    spans = F.array_sort(F.array_distinct(spans))
    joined = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["e"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"),
        ),
    )
    counted = hits.select("doc_id", "_h", joined["n"].alias("n_hit"), F.array_distinct(F.transform("_hits", lambda c: c["item"])).alias("_items"))
    named = (
        counted.select("doc_id", "_h", F.explode("_items").alias("item")).join(_sized(ids, n_windows), "item")
        .groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    on = lambda a, b: a["doc_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_k"])
    rename = lambda df: df.withColumnRenamed("doc_id", "_id").withColumnRenamed("_h", "_k")
    c, m = rename(counted.drop("_items")), rename(named)
    out = lengths.join(c, on(lengths, c), "left").drop("_id", "_k")
    out = out.join(m, on(out, m), "left")
    return out.select(
        "doc_id", F.col("_h").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
