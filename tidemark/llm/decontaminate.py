"""Benchmark decontamination: windows of templates whose numbers, names and units are slots, and consistent slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import KEYS_BROADCAST, is_empty, row_keys, stored, whole, without

WINDOW = 5
LITERALS = 2
LEAST = 0.8
#: Benchmark windows that are broadcast at most: a hash, an item, a place and five words each.
WINDOWS_BROADCAST = 200_000
# Units of measure that follow a number.
UNITS = (
    "mm cm dm m km mg g kg t ml cl dl l ms s sec min h hr hrs hour hours minute minutes second seconds day days week weeks "
    "month months year years inch inches ft feet yard yards mile miles mph kmh oz lb lbs pound pounds ounce ounces "
    "meter meters metre metres liter liters litre litres gram grams kilogram kilograms kilometer kilometers usd eur gbp "
    "dollar dollars euro euros cent cents percent pct degree degrees"
).split()


def prepared(df: DataFrame, text: str, plain: bool = False) -> DataFrame:
    """Adds `_raw` and `_form`, arrays of the same length: the words, lower-cased, and the words with slots.

    Words are runs of letters and digits, cut where a letter follows a digit. A number with separators, decimals, a fraction or a time (`1,250`,
    `4.5`, `3/4`, `12:30`) is one word, written with underscores. A word that starts with a digit becomes `<num>`, a unit
    after a number `<unit>`, any other word that starts with a capital and a small letter `<name>`. `plain` adds `_plain`, without
    names. A null or empty text has no words.
    """
    joined = F.regexp_replace(F.translate(whole(text), "_", " "), r"(?<=\p{N})[.,:/](?=\p{N})", "_")
    df = df.withColumn("_text", F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", " ")))
    t = F.col("_text")
    df = df.withColumn("_text", F.when(F.rlike(t, F.lit(r"\p{N}\p{L}")), F.regexp_replace(t, r"(?<=\p{N})(?=\p{L})", " ")).otherwise(t))
    df = df.withColumn("_marked", F.regexp_replace(t, r"(^| )\p{Lu}\p{Ll}[^ ]*+", "$1<name>"))
    none = F.array().cast("array<string>")

    def words(name: str, slots: bool = True) -> Column:
        c = F.col(name)
        numbers = F.regexp_replace(c, r"(^| )\p{N}[^ ]*+", "$1<num>")
        units = F.regexp_replace(numbers, rf"(?i)(?<=<num> )(?:{'|'.join(UNITS)})(?![^ ])", "<unit>")
        slotted = F.when(F.rlike(c, F.lit(r"\p{N}")), units).otherwise(c) if slots else c
        return F.when(t == "", none).otherwise(F.split(F.lower(slotted), " "))

    forms = {"_raw": words("_text", False), "_form": words("_marked")} | ({"_plain": words("_text")} if plain else {})
    return df.withColumns(forms).drop("_text", "_marked")


def _windows(df: DataFrame, columns: list[str], form: str = "_form") -> DataFrame:
    """One row for each window: its place, its hash, and the words and templates of the whole text."""
    n = F.size(form)
    # A filter on the number of words would move below the regular expressions and run them twice.
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    each = df.select(*columns, "_raw", F.col(form).alias("_form"), F.explode(places).alias("at"))
    return each.withColumn("hash", F.xxhash64(*(F.get(F.col("_form"), F.col("at") + k) for k in range(WINDOW))))


def _cut(words: str) -> Column:
    return F.array(*(F.get(F.col(words), F.col("at") + k) for k in range(WINDOW)))


def _pairs(own: Column) -> Column:
    """The values that the slots of an item's window have in the item and in the document's window, whose words are given."""
    return F.transform(F.filter(
        F.zip_with(F.arrays_zip("words", "slots"), own, lambda x, d: F.struct(
            x["words"].alias("item"), d.alias("value"), x["slots"].alias("slot"))), lambda x: x["slot"]),
        lambda x: F.struct(x["item"].alias("item"), x["value"].alias("value")))


def _judged(hits: DataFrame, group: list[str]) -> DataFrame:
    """The windows of each group (`doc_id`, the columns given, `n_windows`) that fit the most frequent values, and those found as they are."""
    # Grouped by a hash of the item, which is never null, so that later joins need no special case.
    hits = hits.withColumn("group", F.xxhash64(*group, F.lit(7)))
    slots = hits.select("group", F.explode("pairs").alias("p")).groupBy("group", "p.item", "p.value").agg(F.count(F.lit(1)).alias("n"))
    best = slots.groupBy("group", "item").agg(F.max(F.struct("n", "value")).alias("best"))
    best = best.select(F.col("group").alias("_group"), "item", F.col("best.value").alias("best"))
    opened = hits.withColumn("pair", F.explode_outer("pairs"))
    judged = opened.join(best, (F.col("group") == F.col("_group")) & (F.col("pair.item") == F.col("item")), "left")
    fits = F.coalesce(F.col("pair.value") == F.col("best"), F.lit(True))
    equal = F.coalesce(F.col("pair.value") == F.col("pair.item"), F.lit(True))
    named = ["doc_id", *group, "n_windows", "group"]
    each = judged.groupBy(*named, "window", "pairs").agg(F.min(fits).alias("fits"), F.min(equal).alias("equal"))
    return each.groupBy(*named).agg(
        F.countDistinct(F.when(F.col("fits"), F.col("window"))).alias("n_found"),
        F.countDistinct(F.when(F.col("equal"), F.col("window"))).alias("n_verbatim"),
    ).drop("group")


def _by_occurrence(keyed: DataFrame, items: DataFrame, missed: DataFrame, broadcast: bool) -> DataFrame:
    """The pairs in `missed` again, each with the figures of the occurrence of the item that has most of its windows.

    A window's place in the document less its place in the item is where its copy starts. An occurrence is what starts within the item's
    length from a start that has a window, so words put in or left out don't split it, and the next copy isn't in it.
    """
    of_doc = [F.col(k).alias(f"_{k}") for k in ("key1", "key2")]
    same_doc = (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2"))
    gone = missed.select(*of_doc).distinct()
    gone = F.broadcast(gone) if missed.count() <= KEYS_BROADCAST else gone
    windows = _windows(prepared(keyed.join(gone, same_doc, "left_semi"), "text").drop("text"), ["doc_id", "key1", "key2"])
    right = items.withColumnRenamed("hash", "item_hash")
    right = F.broadcast(right) if broadcast else right.hint("merge")
    met = windows.join(right, F.col("hash") == F.col("item_hash")).select(
        "doc_id", "key1", "key2", "item_id", "window", "reach", _pairs(_cut("_raw")).alias("pairs"), (F.col("at") - F.col("place")).alias("start"))
    same = same_doc & F.col("item_id").eqNullSafe(F.col("_item"))
    hits = met.join(missed.select(*of_doc, F.col("item_id").alias("_item"), "n_windows"), same).drop("_key1", "_key2", "_item")
    hits = stored(hits.distinct().withColumn("pair", F.xxhash64("key1", "key2", "item_id", F.lit(3))), "placed")
    cell = F.floor(F.col("start") / F.col("reach"))
    starts = hits.select(F.col("pair").alias("_pair"), F.col("start").alias("first"), cell.alias("_cell")).distinct()
    celled = hits.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    within = (F.col("start") >= F.col("first")) & (F.col("start") < F.col("first") + F.col("reach"))
    placed = celled.join(starts, (F.col("pair") == F.col("_pair")) & (F.col("cell") == F.col("_cell")) & within)
    counted = _judged(placed, ["key1", "key2", "item_id", "first"])
    most = counted.groupBy("doc_id", "key1", "key2", "item_id", "n_windows").agg(F.max(F.struct("n_found", "n_verbatim")).alias("most"))
    return most.select("doc_id", "key1", "key2", "item_id", "n_windows", "most.n_found", "most.n_verbatim")


def _whole_items(keyed: DataFrame, texts: DataFrame, broadcast_limit: int) -> DataFrame:
    """Documents that hold all words of an item one after another: for items (`item_id`, `_raw`) that have no window to search.

    The first words, WINDOW at most, meet by hash; the rest is compared. `n_windows` counts the texts of the item.
    """
    first = F.least(F.size("_raw"), F.lit(WINDOW)).alias("n")
    sizes = texts.groupBy(first).agg(F.max(F.size("_raw")).alias("longest")).orderBy("n").collect()
    longest = max(r["longest"] for r in sizes)

    def start(n: int, at: Column) -> Column:
        return F.xxhash64(F.lit(n), *(F.get(F.col("_raw"), at + k) for k in range(n)))

    head = F.coalesce(*(F.when(first == r["n"], start(r["n"], F.lit(0))) for r in sizes))
    totals = texts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    right = texts.select(F.col("item_id"), F.col("_raw").alias("item"), head.alias("item_hash")).join(
        totals.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    right = F.broadcast(right) if texts.count() <= broadcast_limit else right.hint("merge")
    words = prepared(keyed, "text").select("doc_id", "key1", "key2", "_raw", F.explode(F.sequence(F.lit(0), F.size("_raw"))).alias("at"))
    starts = F.array(*(F.when(F.col("at") + r["n"] <= F.size("_raw"), start(r["n"], F.col("at"))) for r in sizes))
    each = words.select("doc_id", "key1", "key2", F.slice("_raw", F.col("at") + 1, F.lit(longest)).alias("own"), F.explode(starts).alias("hash"))
    met = each.join(right, (F.col("hash") == F.col("item_hash")) & (F.slice("own", F.lit(1), F.size("item")) == F.col("item")))
    n = F.countDistinct("item")
    return met.groupBy("doc_id", "key1", "key2", "item_id", "n_windows").agg(n.alias("n_found"), n.alias("n_verbatim"))


def _candidates(windows: DataFrame, items: DataFrame, least: float, broadcast: bool) -> DataFrame:
    """Pairs of a document and an item that share one of the item's rarest windows.

    A document that holds the share `least` of an item's windows holds one of any set that is larger than the rest. The set taken is that of
    the windows which fewest items have, so a preamble that many items share makes no pairs unless an item is little else.
    """
    item = F.xxhash64("item_id", F.lit(7))
    shared = items.groupBy("hash").agg(F.countDistinct(item).alias("n"))
    rare = items.join(shared, "hash").groupBy("item_id", "window").agg(F.max("n").alias("n"))
    by_item = Window.partitionBy("item_id")
    size = F.count(F.lit(1)).over(by_item)
    rank = F.row_number().over(by_item.orderBy("n", "window"))
    chosen = rare.withColumns({"_rank": rank, "_size": size}).filter(F.col("_rank") <= F.col("_size") - F.floor(F.lit(least) * F.col("_size")) + 1)
    chosen = chosen.select(F.col("item_id").alias("_item"), F.col("window").alias("_window"))
    probes = items.join(chosen, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("window") == F.col("_window")))
    probes = probes.select("item_id", F.col("hash").alias("item_hash")).distinct()
    probes = F.broadcast(probes) if broadcast else probes.hint("merge")
    met = windows.select("key1", "key2", "hash").join(probes, F.col("hash") == F.col("item_hash"))
    return met.select("key1", "key2", "item_id").distinct()


def _hits(keyed: DataFrame, items: DataFrame, candidates: DataFrame, broadcast: bool) -> DataFrame:
    """The windows that the candidates share, with the values of their slots.

    Only windows that some item has leave the documents; each then meets the windows of its document's candidates, so a window that
    many items have gives no rows for those that aren't.
    """
    of_doc = candidates.select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2")).distinct()
    of_doc = F.broadcast(of_doc) if candidates.count() <= KEYS_BROADCAST else of_doc
    docs = keyed.join(of_doc, (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")), "left_semi")
    windows = _windows(prepared(docs, "text").drop("text"), ["doc_id", "key1", "key2"])
    hashes = items.select(F.col("hash").alias("item_hash")).distinct()
    hashes = F.broadcast(hashes) if broadcast else hashes.hint("merge")
    known = windows.join(hashes, F.col("hash") == F.col("item_hash"), "left_semi")
    # Equal hashes are equal templates, so the documents' windows need no count of words outside slots.
    known = known.select("doc_id", "key1", "key2", "hash", _cut("_raw").alias("own")).distinct()
    wanted = candidates.select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2"), F.col("item_id").alias("_item"))
    wanted = wanted.join(items, F.col("_item").eqNullSafe(F.col("item_id"))).drop("_item").withColumnRenamed("hash", "_hash")
    same = (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")) & (F.col("hash") == F.col("_hash"))
    met = known.join(wanted, same).select("doc_id", "key1", "key2", "item_id", "window", _pairs(F.col("own")).alias("pairs"))
    return met.distinct()


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", least: float = LEAST, broadcast_limit: int = WINDOWS_BROADCAST,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, verbatim or with other numbers, names or units.

    Windows of five template words of the whole texts meet by hash. A slot of the item must stand for one value throughout the document:
    of several, the most frequent counts, and windows with another value don't. A pair is reported if at least `least` of the item's
    windows are found so. A pair that isn't is judged again by occurrence, as a document may hold copies with different values: the
    values and windows of each occurrence count by themselves, and the one with most windows is reported. Windows with fewer than two
    words outside slots say nothing and count on neither side; an item without other windows (under five words, or all slots) is found
    where all its words stand one after another, and its texts count as windows. An item without words is never found.

    Returns `doc_id`, `key1`, `key2` (row key), `item_id`, `n_windows`, `n_found`, `n_verbatim`, `coverage` and `kind`, `verbatim` if
    the windows found as they are suffice and else `template`. Repeated rows count once; equal items with different ids are
    each reported; items that share an id are searched together. A null id stays null. Empty tables give no pairs.
    """
    items = prepared(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "text", plain=True)
    texts = items.select("item_id", "_raw").filter(F.size("_raw") > 0).distinct()
    lengths = texts.groupBy("item_id").agg(F.sum(F.size("_raw")).alias("reach"))
    # A window with a name is searched with the slot and with the word, for texts whose case was changed throughout.
    items = _windows(items, ["item_id"]).unionByName(_windows(items, ["item_id"], "_plain"))
    slots = F.transform(_cut("_form"), lambda w: F.substring(w, 1, 1) == "<")
    placed = stored(
        items.select(
            "item_id", "hash", F.xxhash64("item_id", _cut("_raw")).alias("window"), _cut("_raw").alias("words"), slots.alias("slots"),
            F.col("at").alias("place"))
        .filter(F.size(F.filter("slots", lambda x: ~x)) >= LITERALS).distinct(),
        "benchmark",
    )
    items = placed.drop("place").distinct()
    totals = items.groupBy("item_id").agg(F.countDistinct("window").alias("n_windows"))
    keyed = documents.select(
        F.col(doc_id).alias("doc_id"), *(c.alias(n) for n, c in row_keys(doc_id, text).items()), F.col(text).alias("text")
    )
    key = ["doc_id", "key1", "key2"]
    broadcast = placed.count() <= broadcast_limit
    candidates = stored(_candidates(_windows(prepared(keyed, "text"), key), items, least, broadcast), "candidates")
    hits = stored(_hits(keyed, items, candidates, broadcast), "hits")
    many = hits.groupBy(*key, "item_id").agg(F.countDistinct("window").alias("n"))
    same = F.col("item_id").eqNullSafe(F.col("_item"))
    wanted = many.join(totals.withColumnRenamed("item_id", "_item"), same).filter(F.col("n") >= F.lit(least) * F.col("n_windows"))
    wanted = wanted.select(*(F.col(k).alias(f"_{k}") for k in ("key1", "key2")), "_item", "n_windows")
    of_wanted = (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")) & same
    hits = stored(hits.join(wanted, of_wanted).drop("_key1", "_key2", "_item"), "wanted")

    counted = stored(_judged(hits, ["key1", "key2", "item_id"]), "counted")
    enough = F.lit(least) * F.col("n_windows")
    suffices = (F.col("n_found") >= enough) | (F.col("n_verbatim") >= enough)
    found, missed = counted.filter(suffices), counted.filter(~suffices)
    if not is_empty(missed):
        lengths = lengths.withColumnRenamed("item_id", "_item")
        with_reach = placed.join(lengths, same).drop("_item")
        found = found.unionByName(_by_occurrence(keyed, with_reach, missed, broadcast).filter(suffices))
    short = stored(texts.join(totals.select(F.col("item_id").alias("_item")), same, "left_anti"), "short")
    if not is_empty(short):
        found = found.unionByName(_whole_items(keyed, short, broadcast_limit).filter(suffices))
    return found.select(
        *key, "item_id", "n_windows", "n_found", "n_verbatim", (F.col("n_found") / F.col("n_windows")).alias("coverage"),
        F.when(F.col("n_verbatim") >= enough, "verbatim").otherwise("template").alias("kind"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    return without(documents, contamination(documents, benchmark, doc_id=doc_id, text=text, **options), doc_id, text)
