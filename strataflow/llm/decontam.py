"""Benchmark decontamination by template windows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.sql import let, windows
from strataflow.session import cut

#: Words of a window, and the share of an item's windows that a document has to hold.
WINDOW = 5
SHARE = 0.8
#: Places of hits, of four bytes each, up to which they are broadcast to the texts; beyond, both sides are shuffled by row.
BROADCAST_PLACES = 4_000_000

# Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|cl|l|s|sec|min|h|hr|hrs|hours|minutes|seconds|days|weeks|months|years|miles|feet|inches|metres|meters|litres|liters|grams|dollars|euros|pounds|cents|percent|usd|eur|mph|kmh|kwh|kw|w|v|hz|gb|mb|kb"

NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Marks before a name and a unit, and between the words of a name, while a text is cut into words; all are removed from texts first.
NAME_MARK, UNIT_MARK, NAME_JOIN = "\x01", "\x02", "\x03"


def marked_words(text: Column) -> Column:
    """The words of a text as written, with a mark before each name and unit.

    A word is a run of letters, marks and digits; points and commas between digits belong to
    a number. A name is a capitalised word, or several with single spaces between them, which
    are one word here; a unit is one of UNITS behind a number.
    """
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), NAME_MARK + UNIT_MARK + NAME_JOIN, "   ")
    t = F.regexp_replace(t, r"(?<=\p{N})(\s?)((?i:" + UNITS + r"))(?![\p{L}\p{N}])", "$1 " + UNIT_MARK + "$2")
    t = F.regexp_replace(t, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\p{N}\x02])", NAME_MARK)
    t = F.regexp_replace(t, r"(\x01[\p{L}\p{M}\p{N}]+) (?=\x01)", "$1" + NAME_JOIN)
    return F.filter(F.split(t, r"(?:[^\p{L}\p{M}\p{N}\x01-\x03.,]|(?<!\p{N})[.,]|[.,](?!\p{N}))+"), lambda w: w != "")


def plain(word: Column) -> Column:
    """A marked word without its marks, in lower case."""
    return F.lower(F.translate(word, NAME_JOIN + NAME_MARK + UNIT_MARK, " "))


def template(word: Column) -> Column:
    """A marked word's place in a template: a typed placeholder, or the word in lower case."""
    first = F.substring(word, 1, 1)
    return F.when(first == NAME_MARK, F.lit(NAME)).when(first == UNIT_MARK, F.lit(UNIT)).when(first.between("0", "9"), F.lit(NUMBER)).otherwise(F.lower(word))


def slotted(words: Column) -> Column:
    """Each marked word's template ``t`` and, of placeholders only, the word ``l`` that stands there."""
    first = lambda w: F.substring(w, 1, 1)
    slot = lambda w: first(w).isin(NAME_MARK, UNIT_MARK) | first(w).between("0", "9")
    return F.transform(words, lambda w: F.struct(template(w).alias("t"), F.when(slot(w), plain(w)).alias("l")))


def window_hashes(tokens: Column, widths: list[int]) -> Column:
    """(pos, hash) of each window of ``tokens`` (``slotted``), of each of the ``widths``.

    A window that holds a word is hashed as a template. Placeholders alone fit any row of
    numbers or names, so that a window of nothing else is hashed by what stands there.
    """

    def of(t: Column, n: int) -> Column:
        def key(i: Column) -> Column:
            at = [F.get(t, i + k) for k in range(n)]
            bare = F.lit(True)
            for x in at:
                bare = bare & x.l.isNotNull()
            return F.when(bare, F.xxhash64(F.lit("="), *[x.l for x in at])).otherwise(F.xxhash64(*[x.t for x in at]))

        return F.transform(windows(F.size(t), n), lambda i: F.struct(i.alias("pos"), key(i).alias("hash")))

    return let(tokens, lambda t: F.concat(*[of(t, n) for n in widths]))


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item, form, item_id, width, n_windows, i_pos, hash, i_words) of all items' windows.

    An item has up to two forms: its template, and its words in lower case with numbers and
    units as placeholders but names as they are, for copies that lost their capitals. An item
    of fewer words than ``width`` is one window of its own width. Null and blank items have none.
    """
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").dropDuplicates(["item", "item_id"])
    marked = rows.select("item_id", "item", marked_words(F.col("text")).alias("w"))
    words = F.flatten(F.transform("w", lambda w: F.when(F.substring(w, 1, 1) == NAME_MARK, F.split(plain(w), " ")).otherwise(F.array(w))))
    forms = marked.select("item_id", "item", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("form"), F.col("w")), F.struct(F.lit(1).alias("form"), words.alias("w"))))).alias("f"))
    forms = forms.select("item_id", "item", "f.form", "f.w").where(F.size("w") > 0).select("*", slotted(F.col("w")).alias("t"), F.least(F.size("w"), F.lit(width)).alias("width"))
    short = F.coalesce(*[F.when(F.col("width") == n, window_hashes(F.col("t"), [n])) for n in range(1, width + 1)])
    hashes = forms.select("item_id", "item", "form", "w", "width", (F.size("w") - F.col("width") + 1).alias("n_windows"), F.inline(short).alias("i_pos", "hash"))
    return hashes.select("item", "form", "item_id", "width", "n_windows", "i_pos", "hash", F.transform(F.slice("w", F.col("i_pos") + 1, F.col("width")), plain).alias("i_words"))


def row_key(docs: DataFrame) -> Column:
    """A row's own key: of its doc_id and text together, so that rows without an id or with a repeated one stay apart."""
    return F.xxhash64(docs["doc_id"], docs["doc_id"].isNull(), docs["text"].cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_literal, share, row) of every document that holds a benchmark item.

    Of the document's template windows those that an item has are kept, by place and hash. A
    pair that reaches ``share`` holds one of the windows that the item can't do without (its
    rarest ones), so that common windows make no pairs; a pair's distinct hashes are counted
    before its places meet. Of the pairs that could reach ``share`` the words are fetched: matches on one diagonal
    (document place less item place) belong to one copy, where each slot value of the item
    has to stand for one value of the document and the reverse, or only its literally equal
    windows count. A pair is reported if at least ``share`` of the item's windows are found;
    of an item with fewer than ``width`` words all words have to be equal. Each row is judged
    by itself, ``row`` is its ``row_key``; repeated rows are reported once. Null and blank
    texts hold nothing; an empty benchmark or table gives no rows.
    """
    items = cut(item_windows(benchmark, width))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    if not widths:
        widths = [width]
    keyed = docs.select(F.col("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    # the generator takes the expression itself: over a column, Spark would filter empty arrays first and compute them twice
    places = keyed.select("doc_id", "row", F.inline(window_hashes(slotted(marked_words(F.col("text"))), widths)).alias("d_pos", "hash"))
    hits = cut(places.join(items.select("hash").distinct(), "hash", "left_semi").distinct())
    pair = ["row", "item", "form"]
    often = items.join(hits.groupBy("hash").agg(F.count("*").alias("often")), "hash", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    ranked = often.withColumn("rank", F.expr("row_number() over (partition by item, form order by often, i_pos)"))
    lead = ranked.where((F.col("often") > 0) & (F.col("rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * share) + 1)).select("hash", "item", "form").distinct()
    held = hits.select("row", "hash").distinct()
    weights = items.groupBy("item", "form", "item_id", "width", "n_windows", "hash").agg(F.count("*").alias("n"))
    able = held.join(lead, "hash").select(*pair).distinct().join(held, "row").join(weights, ["item", "form", "hash"])
    able = able.groupBy(*pair, "item_id", "width", "n_windows").agg(F.sum("n").alias("n")).where(F.col("n") >= share * F.col("n_windows")).drop("n")
    met = hits.join(able, "row").join(items.select("item", "form", "hash", "i_pos"), ["item", "form", "hash"])
    met = cut(met.select("doc_id", *pair, "item_id", "width", "n_windows", "i_pos", "d_pos").distinct())

    # of each such row only the words of its hits are fetched; the rows' places are as many as the row has words at most
    wanted = cut(met.groupBy("row").agg(F.collect_set("d_pos").alias("places")))
    if wanted.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0] <= BROADCAST_PLACES:
        wanted = F.broadcast(wanted)
    texts = keyed.join(wanted, "row").dropDuplicates(["row"])
    spelt = let(marked_words(F.col("text")), lambda w: F.transform("places", lambda i: F.struct(i.alias("d_pos"), F.transform(F.slice(w, i + 1, width), plain).alias("d_words"))))
    met = met.join(texts.select("row", F.inline(spelt)), ["row", "d_pos"])
    met = met.join(items.select("item", "form", "i_pos", "i_words").distinct(), ["item", "form", "i_pos"])
    slots = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.struct(F.get("i_words", k).alias("i"), F.get("d_words", k).alias("d")))
    met = met.withColumn("slots", slots).withColumn("literal", F.forall("slots", lambda z: z.i == z.d))
    # at most an item's windows share a diagonal, so that its slots fit a row
    copy = met.groupBy("doc_id", *pair, "item_id", "width", "n_windows", (F.col("d_pos") - F.col("i_pos")).alias("diagonal")).agg(
        F.collect_set("i_pos").alias("places"),
        F.collect_set(F.when(F.col("literal"), F.col("i_pos"))).alias("literal_places"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )
    left = F.size(F.array_distinct(F.transform("slots", lambda z: z.i)))
    right = F.size(F.array_distinct(F.transform("slots", lambda z: z.d)))
    consistent = (left == F.size("slots")) & (right == F.size("slots")) & (F.col("width") == width)
    counted = F.when(consistent, F.col("places")).otherwise(F.col("literal_places"))
    each = copy.select("doc_id", *pair, "item_id", "n_windows", F.explode(counted).alias("i_pos"), "literal_places").withColumn("literal", F.array_contains("literal_places", F.col("i_pos")))
    windows_found = each.groupBy("doc_id", *pair, "item_id", "n_windows", "i_pos").agg(F.max("literal").alias("literal"))
    found = windows_found.groupBy("doc_id", *pair, "item_id", "n_windows").agg(F.count("*").alias("n_found"), F.count_if("literal").alias("n_literal"))
    found = found.withColumn("share", F.col("n_found") / F.col("n_windows")).where(F.col("share") >= share)
    best = found.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("share", "n_literal", "n_found", "n_windows")).alias("f"))
    return best.select("doc_id", "item_id", F.col("f.n_windows").cast("long").alias("n_windows"), F.col("f.n_found").alias("n_found"), F.col("f.n_literal").alias("n_literal"), F.col("f.share").alias("share"), "row")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    bad = contaminated(docs, benchmark).select(F.col("row").alias("__row")).distinct()
    return docs.join(bad, row_key(docs) == bad["__row"], "left_anti")
