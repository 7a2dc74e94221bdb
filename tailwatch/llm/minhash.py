"""Near duplicates by bottom-k sketches of one hash function, with every link confirmed on full shingle sets.

1. Each text becomes its set of hashed word shingles; equal sets are one class, named after its smallest key.
2. A class's sketch is the k smallest hashes of its set. Inverted lists of sketch values give candidates: two sets of the
   asked similarity share at least ``t`` sketch values, so each class needs lists for all but its t - 1 most frequent
   values only (all sketches agree on the order: rare values first). Passages that many texts share drop out there.
3. Candidates are compared by the sketch of their union, then exactly on full sets. Rather than all pairs of a list,
   first every class is compared with one hub of its longest list, then with a hashed hub of each of its lists. Groups of
   near copies collapse in these rounds. Classes whose lists still hold another component get lists over their whole
   sets, where only a fifth of a set's values, the rarest, need one, and meet all members in other components there.
   Pairs within a component are never needed, as the result is components.

t comes from the binomial tail: a sample of k of the union hits the intersection k * 0.8 times on average, and fewer than
t times with probability below 1e-8. For sets that sketches hold whole, t is exact and nothing can be lost.

Defined results: null or blank texts have empty sets and are linked with nothing; a text of fewer words than a shingle
has its whole word sequence as its one shingle; a null key is kept and named by nothing; rows that repeat a key belong
together; an empty table gives an empty one. The key names a text. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import components, with_window_hashes, words_of

#: Sketch size, and the overlap that sketches of similar sets reach but for one case in 1e8 (similarity 0.8).
SKETCH, SHARED = 96, 48


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z only. Plain lower() does that for words of ASCII letters, which most are."""
    mapped = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).when(word.rlike("[A-Z]"), mapped).otherwise(word)


def with_shingles(docs: DataFrame, text: str, width: int, out: str) -> DataFrame:
    """Adds the sorted set of 64-bit shingle hashes of a text."""
    hashes = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(ascii_lower(w)))
    df = with_window_hashes(docs.withColumn("_h", hashes), "_h", width, "_hw")
    whole = F.array(F.aggregate("_h", F.lit(7).cast("long"), lambda s, x: F.xxhash64(s, x)))
    shingles = F.when(F.size("_h") >= width, F.array_distinct("_hw")).when(F.size("_h") > 0, whole).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, F.sort_array(shingles)).drop("_h", "_hw")


def needed_overlap(n: Column, share: float) -> Column:
    """How many sketch values two sets of the asked similarity have in common at least."""
    return F.when(n <= int(SKETCH * share), F.ceil(n * F.lit(share) - F.lit(1e-9))).otherwise(SHARED).cast("int")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component. ``percent``: least similarity in hundredths, 80 or more."""
    if percent < 80:
        raise ValueError("the sketch overlap is set for similarities of 0.8 or more")
    share = percent / 100
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    shingled = with_shingles(source, "_text", width, "_set")
    table = pin(shingled.select("id", F.size("_set").alias("n"), F.xxhash64("_set").alias("s1"), F.hash("_set").alias("s2"), F.slice("_set", 1, SKETCH).alias("sketch")))
    classes = table.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    placed = pin(table.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    reps = placed.where("id = rep and n > 0").select("id").distinct()
    sketches = pin(table.select("id", "n", "sketch").join(reps, "id").dropDuplicates(["id"]))
    lists = _lists(sketches.withColumnRenamed("sketch", "values"), needed_overlap(F.col("n"), share))
    active = pin(lists.select("id").distinct())
    sets = pin(with_shingles(source.join(active, "id").dropDuplicates(["id"]), "_text", width, "_set").select("id", F.col("_set").alias("set")))
    groups = _linked(lists, active, sets, percent)
    return (placed.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
            .select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component")))


def _lists(sets: DataFrame, overlap: Column) -> DataFrame:
    """Inverted lists (value, id, n, after, m) that can hold a link, from rows id, n, values.

    ``overlap``: how many values two similar rows have in common at least. All but the overlap - 1 most frequent values
    of a row have lists; values that no other row has need none. ``after``: how many values of the row are more frequent.
    """
    postings = sets.select("id", "n", F.explode("values").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # the values of one row come together again, never those of a list
    frequent = postings.join(shared, "value").groupBy("id", "n").agg(F.collect_list(F.struct("df", "value")).alias("v"))
    ranked = F.transform(F.sort_array("v", asc=False), lambda x, k: F.struct(x["value"].alias("value"), k.alias("after")))
    kept = frequent.where(F.size("v") >= overlap).select("id", "n", F.explode(F.slice(ranked, overlap, F.size("v"))).alias("p"))
    lists = pin(kept.select("id", "n", "p.value", "p.after"))
    used = lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    return pin(lists.join(used, "value"))


def _close(a: str, b: str, percent: int) -> Column:
    """Whether set sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _parities(sets: DataFrame) -> DataFrame:
    """256 parity bits of each set, as bits: the parity of how many values fall on a bit."""
    word = "aggregate(values, 0L, (s, h) -> if(((h >> 6) & 3) = {w}, s ^ shiftleft(1L, cast(h & 63 as int)), s))"
    return sets.select("id", F.array(*[F.expr(word.format(w=w)) for w in range(4)]).alias("bits"))


def _can_reach(percent: int) -> Column:
    """Necessary for the similarity of two whole sets that share a value: enough values from there on, and parity bits
    that differ in no more places than the sets may differ in values. Both bounds are exact; nothing similar fails."""
    both = F.col("n") + F.col("n_2")
    overlap = F.ceil(F.lit(percent) * both / (100 + percent) - F.lit(1e-9))
    differ = sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_2", F.lit(i)))) for i in range(4))
    return (1 + F.least("after", "after_2") >= overlap) & (differ <= both - 2 * overlap)


def _pairs(left: DataFrame) -> DataFrame:
    return left.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a < b").distinct()


def _linked(lists: DataFrame, active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    longest = lists.groupBy("id").agg(F.max_by("value", F.struct("m", "value")).alias("value"))
    least = lists.groupBy("value").agg(F.min_by(F.struct("id", "n"), "id").alias("hub"))
    first = lists.select("id", "n", "value").join(longest, ["id", "value"]).join(least, "value").where(_close("n", "hub.n", percent))
    links = pin(_confirmed(_pairs(first.withColumn("other", F.col("hub.id"))), sets, percent))
    groups = pin(components(active, links))

    # a hub of its own for each list, drawn by a hash, for members that are not yet in the hub's component
    placed = _split_lists(lists, groups)
    drawn = placed.groupBy("value").agg(F.min_by(F.struct("id", "n", "component"), F.struct(F.xxhash64("value", "id"), "id")).alias("hub"))
    second = placed.join(drawn, "value").where(F.col("component") != F.col("hub.component")).where(_close("n", "hub.n", percent))
    links = links.union(pin(_confirmed(_pairs(second.withColumn("other", F.col("hub.id"))), sets, percent)))
    groups = pin(components(active, links))

    # the rest, exactly: lists over whole sets, for members that share a list with another component
    left = _split_lists(lists, groups).select("id").distinct()
    whole = sets.join(left, "id").select("id", F.size("set").alias("n"), F.col("set").alias("values"))
    exact = _lists(whole, F.ceil(F.col("n") * F.lit(percent / 100) - F.lit(1e-9)).cast("int"))
    placed = _split_lists(exact, groups).join(pin(_parities(whole)), "id")
    right = placed.select("value", *[F.col(c).alias(f"{c}_2") for c in placed.columns if c != "value"])
    third = placed.join(right, "value").where("id < id_2 and component <> component_2").where(_can_reach(percent)).withColumn("other", F.col("id_2"))
    more = pin(_confirmed(_pairs(third), sets, percent))
    return pin(components(active, links.union(more)))


def _split_lists(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists whose members are in more than one component, with the component."""
    placed = pin(lists.select("value", "id", "n", "after").join(groups, "id"))
    mixed = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    return pin(placed.join(mixed, "value"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the union sketch and then the exact test."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    sx, sy = F.slice("x", 1, SKETCH), F.slice("y", 1, SKETCH)
    union = F.slice(F.sort_array(F.array_union(sx, sy)), 1, SKETCH)
    hits = F.size(F.array_intersect(F.array_intersect(union, sx), sy))
    inter = F.size(F.array_intersect("x", "y"))
    exact = 100 * inter >= percent * (F.size("x") + F.size("y") - inter)
    promising = (F.size(union) < SKETCH) | (hits >= SHARED)
    return both.where(F.when(promising, exact).otherwise(False)).select("a", "b")
