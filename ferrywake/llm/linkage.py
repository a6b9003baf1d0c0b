"""Matching entities of two sources without a shared key (problem 4): collective graph linkage.

Records that share attributes (name words, name trigrams, whole names, map cells) become candidate edges, weighted by how rare
these are. Meta-blocking keeps for each record the edges near its heaviest one. What an edge is worth is learned from the tables themselves: names are compared by
words weighted by their rarity, places by distance, and the rates of each degree of agreement among partners and among others are estimated without labels, a
record having at most one partner. The result is refined by propagation: how well the partners of a record's neighbours agree with the edge is learned
and counted in the same way, again and again until no partner changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywake.operators.proximity import point_code
from ferrywake.operators.series import haversine
from ferrywake.session import discard, materialize

CELL = 0.006  #: degrees of latitude of a map cell, about 670 m
#: Bounds of the degrees of agreement: of names (0 to 1), of places (metres) and of neighbours (0 to 1).
NAME_STEPS = (0.3, 0.45, 0.6, 0.7, 0.8, 0.9, 0.97)
PLACE_STEPS = (60.0, 125.0, 250.0, 500.0, 1_000.0, 2_000.0, 5_000.0, 20_000.0)
SUPPORT_STEPS = (0.1, 0.3, 0.5, 0.7)


def normal_name(name: Column) -> Column:
    """Lower-case words without punctuation and bracketed additions; null becomes ''."""
    low = F.lower(F.coalesce(name, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", " "), "&", " and "), "['’`]", "")
    return F.array_join(F.filter(F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), " +"), lambda w: w != ""), " ")


def other_name(name: Column) -> Column:
    """What a bracketed addition says, which may be another name; null without one."""
    found = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"\(([^)]*)\)", 1)
    return F.when(found != "", normal_name(found))


def _records(df: DataFrame, rid: str, name: str, lat: str, lon: str) -> DataFrame:
    """One record per id: its names (one row each in `names`) and a place; coordinates in the wrong order are put right."""
    base = df.select(F.col(rid).cast("string").alias("rid"), F.col(name).cast("string").alias("raw"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("rid is not null")
    return base.withColumn("names", F.array_distinct(F.filter(F.array(normal_name(F.col("raw")), other_name(F.col("raw"))), lambda x: x.isNotNull() & (x != ""))))


def _places(records: DataFrame) -> DataFrame:
    good = F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    by = records.groupBy("rid").agg(
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.min(F.when(good, F.struct("lat", "lon"))).alias("at")
    )
    return by.select("rid", "names", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


def _attributes(records: DataFrame, spread: bool) -> DataFrame:
    """Rows (``rid``, ``key``). ``spread`` adds the eight cells around."""
    words = F.flatten(F.transform("names", lambda n: F.transform(F.split(n, " "), lambda w: F.concat(F.lit("t:"), w))))
    grams = F.flatten(F.transform("names", lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.lit("g:"), F.substring(F.concat(F.lit("^"), n, F.lit("$")), i, F.lit(3))))))
    whole = F.transform("names", lambda n: F.concat(F.lit("n:"), F.array_join(F.array_sort(F.split(n, " ")), " ")))
    steps = F.array(*[F.lit(k) for k in ((-1, 0, 1) if spread else (0,))])
    iy, ix = F.floor(F.col("lat") / CELL), F.floor(F.col("lon") / (2 * CELL))
    cells = F.coalesce(F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.concat_ws(":", F.lit("c"), iy + a, ix + b)))), F.array().cast("array<string>"))
    cells = F.when(F.col("lat").isNotNull(), cells).otherwise(F.array().cast("array<string>"))
    return records.select("rid", F.explode(F.array_distinct(F.concat(words, grams, whole, cells))).alias("key"))


def _word_weights(records: DataFrame, worth: DataFrame | None = None) -> DataFrame:
    """Per record: its names as arrays of (word, weight), the weight being the word's rarity on this side, times its ``worth`` if that is known."""
    words = records.select("rid", F.posexplode("names").alias("n", "name")).select("rid", "n", F.posexplode(F.split("name", " ")).alias("i", "w"))
    common = words.select("rid", "w").distinct().groupBy("w").agg(F.count("*").alias("df"))
    total = F.lit(float(max(1, records.count())) + 1.0)
    weighed = words.join(common, "w").withColumn("v", F.log(total / F.col("df")))
    if worth is not None:
        weighed = weighed.join(worth, "w", "left").withColumn("v", F.col("v") * F.coalesce("worth", F.lit(1.0)))
    names = weighed.groupBy("rid", "n").agg(F.array_sort(F.collect_list(F.struct("i", "w", "v"))).alias("ws"))
    return names.groupBy("rid").agg(F.collect_list("ws").alias("named"))


def _worth(pairs: DataFrame, own: str, other: str) -> DataFrame:
    """How often each word of one side finds its like in the name of a near partner: what only says what a record is finds none, and then weighs nothing."""
    hit = F.array_max(F.transform(other, lambda y: _word_similarity(F.col("x.w"), y["w"]))) > 0
    words = pairs.select(F.explode(own).alias("x"), other).select(F.col("x.w").alias("w"), hit.cast("int").alias("hit"))
    return words.groupBy("w").agg(((F.sum("hit") + 2.0) / (F.count("*") + 2.0)).alias("worth"))


def _word_similarity(x: Column, y: Column) -> Column:
    """1 for equal words, 0.9 for one whose letters are in another order or left out behind the first (an abbreviation); else by edit distance, if most letters agree."""
    short, long = F.when(F.length(x) < F.length(y), x).otherwise(y), F.when(F.length(x) < F.length(y), y).otherwise(x)
    shortened = (F.length(short) < F.length(long)) & F.rlike(long, F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*")))
    ratio = 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return F.when(x == y, 1.0).when(shortened | (letters(x) == letters(y)), F.greatest(F.lit(0.9), ratio)).otherwise(F.when(ratio >= 0.6, ratio).otherwise(0.0))


def _name_similarity(a: Column, b: Column) -> Column:
    """Share of both names' word weights that finds its like in the other; names that differ in blanks only are compared as a whole."""
    met = lambda p, q: F.aggregate(p, F.lit(0.0), lambda s, x: s + x["v"] * F.array_max(F.transform(q, lambda y: _word_similarity(x["w"], y["w"]))))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x["v"])
    glued = lambda p: F.array_join(F.transform(p, lambda x: x["w"]), "")
    whole = 1.0 - F.levenshtein(glued(a), glued(b)) / F.greatest(F.length(glued(a)), F.length(glued(b)))
    by_words = F.try_divide(met(a, b) + met(b, a), total(a) + total(b))
    return F.greatest(F.coalesce(by_words, F.lit(0.0)), F.when(whole >= 0.9, whole).otherwise(0.0))


def _degree(value: Column, steps: tuple[float, ...]) -> Column:
    """Number of the interval a value lies in; -1 for null."""
    out = F.when(value.isNull(), -1)
    for k, step in enumerate(steps):
        out = out.when(value < step, k)
    return out.otherwise(len(steps)).cast("int")


def candidate_edges(a: DataFrame, b: DataFrame, rare: int, keep: float) -> DataFrame:
    """Edges (``aid``, ``bid``) between records that share attributes, pruned by weight.

    An attribute of ``na`` and ``nb`` records makes edges if their harmonic mean is at most ``2 rare``, so that it makes at most ``rare`` edges per record that
    has it. A record that this leaves without edges is looked up by its broader attributes two at a time, and then by all of them together.
    """
    ka, kb = _attributes(a, False), _attributes(b, True)
    n = F.lit(float(a.count() + b.count()))

    def shared(left: DataFrame, right: DataFrame) -> DataFrame:
        count = lambda k, name: k.groupBy("key").agg(F.count("*").alias(name))
        return materialize(count(left, "na").join(count(right, "nb"), "key").withColumn("light", F.col("na") * F.col("nb") <= rare * (F.col("na") + F.col("nb"))))

    def edges(left: DataFrame, right: DataFrame, keys: DataFrame) -> DataFrame:
        light = keys.where("light").select("key", (F.log(n / F.sqrt(F.col("na") * F.col("nb"))) + 0.1).alias("w"))
        met = left.join(light, "key").withColumnRenamed("rid", "aid").join(right.withColumnRenamed("rid", "bid"), "key")
        return met.groupBy("aid", "bid").agg(F.sum("w").alias("weight"), F.max(F.col("key").startswith("c:")).alias("cell"))

    keys = shared(ka, kb)
    found = materialize(edges(ka, kb, keys))
    for two in (True, False):
        broad = keys.where("not light").select("key")
        lost = materialize(kb.join(found.select(F.col("bid").alias("rid")).distinct(), "rid", "left_anti").join(broad, "key"))
        if lost.isEmpty():
            break
        wanted = lost.select("key").distinct()
        gather = lambda k: k.groupBy("rid").agg(F.array_sort(F.collect_set("key")).alias("ks"))
        if two:
            joined = lambda k: gather(k).select("rid", F.explode(F.flatten(F.transform("ks", lambda x, i: F.transform(F.slice(F.col("ks"), i + 2, F.size("ks")), lambda y: F.concat_ws("\x01", x, y))))).alias("key"))
        else:
            joined = lambda k: gather(k).select("rid", F.concat(F.lit("all:"), F.array_join("ks", "\x01")).alias("key"))
        ca, cb = joined(ka.join(wanted, "key")), joined(lost)
        found = materialize(found.unionByName(edges(ca, cb, shared(ca, cb))))
    top = F.max("weight").over(Window.partitionBy("bid"))
    return found.withColumn("top", top).where((F.col("weight") >= keep * F.col("top")) | F.col("cell")).select("aid", "bid", "weight")


def _logs(hits: list[float], misses: list[float], grades: list[float]) -> list[float]:
    """Logarithms of the ratio of rates with one observation's worth of prior belief on each side (``grades``: how well a degree agrees, 0 to 1)."""
    n, g = len(grades), sum(grades)
    m, u = sum(hits) + 1, sum(misses) + 1
    return [math.log((h + x / g) / m) - math.log((s + (1 - x) / (n - g)) / u) for h, s, x in zip(hits, misses, grades)]


class Evidence:
    """What degrees of agreement are worth, as logarithms of (rate among partners / rate among others), learned without labels.

    Places are learned from edges whose names are equal and equal to no other's, whatever their places; names from edges whose places are closest, less the
    strangers to be expected there, whatever their names. So neither kind of evidence vouches for itself. All tables that are counted have one row per combination of degrees.
    """

    def __init__(self, edges: DataFrame) -> None:
        top = len(NAME_STEPS)
        same = F.col("name") == top
        alone = lambda k: F.count_if(same).over(Window.partitionBy(k)) == 1
        counts = edges.withColumn("sole", same & alone("bid") & alone("aid")).groupBy("name", "place", "sole").agg(F.count("*").alias("c")).collect()
        names, places = range(len(NAME_STEPS) + 1), range(len(PLACE_STEPS) + 1)
        total = lambda keep: float(sum(r.c for r in counts if keep(r)))
        nearness = [(len(places) - k - 0.5) / len(places) for k in places]
        likeness = [(k + 0.5) / len(names) for k in names]
        self.place = _logs([total(lambda r: r.place == k and r.sole) for k in places], [total(lambda r: r.place == k and 0 <= r.name <= top // 2) for k in places], nearness)
        core = range(max(places, key=lambda k: self.place[k]) + 1)
        far = [k for k in places if self.place[k] < 0]
        strangers = [total(lambda r: r.name == k and r.place in far) for k in names]
        drawn = total(lambda r: 0 <= r.name <= top // 2 and r.place in core)  # too unlike to be partners: strangers, in their usual proportion to others
        scale = drawn / max(1.0, sum(strangers[: top // 2 + 1]))
        near = [total(lambda r: r.name == k and r.place in core) for k in names]
        self.name = _logs([max(0.0, n - scale * s) for n, s in zip(near, strangers)], strangers, likeness)
        self.support: dict[tuple[int, int], float] = {}
        self.partnered = 0.5
        while True:
            p = self.judged(edges.withColumn("support", F.lit(-1))).agg(F.sum("p").alias("p"), F.sum(1.0 / F.col("n")).alias("records")).first()
            share = min(0.98, max(0.02, ((p.p or 0.0) + 0.5) / ((p.records or 0.0) + 1.0)))
            moved, self.partnered = abs(share - self.partnered), share
            if moved < 0.005:
                break

    def odds(self) -> Column:
        """Odds of an edge that it joins partners, before the other edges of its record are looked at."""
        table = lambda kv, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in kv for x in pair]), key), F.lit(0.0)) if kv else F.lit(0.0)
        by_support = table([(16 * p + s, v) for (p, s), v in self.support.items()], 16 * F.col("place") + F.col("support"))
        known = table(list(enumerate(self.name)), F.col("name")) + table(list(enumerate(self.place)), F.col("place")) + F.when(F.col("support") >= 0, by_support).otherwise(0.0)
        return F.exp(F.lit(math.log(self.partnered / (1 - self.partnered))) + known) / F.col("n")

    def judged(self, edges: DataFrame) -> DataFrame:
        """Edges with ``p``, the probability that they join partners, a record having at most one."""
        return edges.withColumn("o", self.odds()).withColumn("p", F.col("o") / (1.0 + F.sum("o").over(Window.partitionBy("bid")))).drop("o")

    def learn_support(self, edges: DataFrame) -> None:
        """What neighbours' agreement is worth beyond the place itself: rates within each degree of the place, by the evidence of names and places alone."""
        self.support = {}
        rows = self.judged(edges).where("support >= 0").groupBy("place", "support").agg(F.sum("p").alias("p"), F.count("*").alias("c")).collect()
        grades = [(k + 0.5) / (len(SUPPORT_STEPS) + 1) for k in range(len(SUPPORT_STEPS) + 1)]
        by = {(r.place, r.support): (r.p, r.c - r.p) for r in rows}
        for place in {r.place for r in rows}:
            both = [by.get((place, k), (0.0, 0.0)) for k in range(len(grades))]
            self.support |= {(place, k): v for k, v in enumerate(_logs([h for h, _ in both], [m for _, m in both], grades))}


def link(
    left: DataFrame, left_id: str, left_name: str, left_lat: str, left_lon: str, right: DataFrame, right_id: str, right_name: str, right_lat: str, right_lon: str,
    rare: int = 30, keep: float = 0.4, least: float = 0.5, neighbours: int = 4,
) -> DataFrame:
    """The best partner in ``right`` of each record in ``left``: ``left_id, right_id, confidence`` (above ``least``, to 1); many have none.

    Rows with equal ids are one record with several names. Missing names or places leave the other evidence; ids are compared as strings; a record without both has
    no partner, nor has one whose candidates can't be told apart, as their probabilities add up to 1 at most. ``rare`` bounds the edges an attribute makes
    per record (see `candidate_edges`); records that agree with more than so many on each side in all they have can't be told apart. Empty tables give no rows.
    """
    a = materialize(_places(_records(right, right_id, right_name, right_lat, right_lon)))
    # a source whose pairs are mostly ordered (lon, lat) may hold some the other way round: take the order in which other records lie near
    b_raw = _places(_records(left, left_id, left_name, left_lat, left_lon))
    box = a.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    if box.s is not None:
        pad = 0.2
        inside = F.col("lat").between(box.s - pad, box.n + pad) & F.col("lon").between(box.w - pad, box.e + pad)
        turned = F.col("lon").between(box.s - pad, box.n + pad) & F.col("lat").between(box.w - pad, box.e + pad)
        b_raw = b_raw.withColumn("t", ~inside & turned).select("rid", "names", F.when(F.col("t"), F.col("lon")).otherwise(F.col("lat")).alias("lat"), F.when(F.col("t"), F.col("lat")).otherwise(F.col("lon")).alias("lon"))
    b = materialize(b_raw)
    side = lambda t, p, worth=None: t.join(_word_weights(t, worth), "rid", "left").select(F.col("rid").alias(f"{p}id"), F.col("named").alias(f"{p}n"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    found = materialize(candidate_edges(a, b, rare, keep))
    metres = haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    best_names = F.array_max(F.flatten(F.transform("an", lambda x: F.transform("bn", lambda y: F.struct(_name_similarity(x, y).alias("s"), x.alias("x"), y.alias("y"))))))
    close = found.join(side(a, "a"), "aid").join(side(b, "b"), "bid").where(metres < PLACE_STEPS[2]).select(best_names.alias("m")).where(F.col("m.s") >= 0.6).select("m.x", "m.y")
    close = materialize(close.withColumnsRenamed({"x": "xs", "y": "ys"}))
    pairs = found.join(side(a, "a", _worth(close, "xs", "ys")), "aid").join(side(b, "b", _worth(close, "ys", "xs")), "bid")
    name = F.array_max(F.flatten(F.transform("an", lambda x: F.transform("bn", lambda y: _name_similarity(x, y)))))
    per = F.count("*").over(Window.partitionBy("bid")).alias("n")
    cand = materialize(pairs.select("aid", "bid", "alat", "alon", _degree(name, NAME_STEPS).alias("name"), _degree(metres, PLACE_STEPS).alias("place"), per))

    # neighbours of a record: the ones before and after along the Z-order curve
    coded = b.where("lat is not null").select("rid", "lat", "lon", point_code(F.col("lat"), F.col("lon")).alias("code")).withColumn("area", F.shiftright("code", 22))
    order = Window.partitionBy("area").orderBy("code", "rid")
    ring = F.array(*[F.struct(f(F.struct("rid", "lat", "lon"), k).over(order).alias("at")) for k in range(1, neighbours + 1) for f in (F.lag, F.lead)])
    near = coded.withColumn("ring", ring).select(F.col("rid").alias("bid"), "lat", "lon", F.explode("ring.at").alias("o")).where(F.col("o.rid").isNotNull())
    near = materialize(near.select("bid", F.col("o.rid").alias("nid"), haversine(F.col("lat"), F.col("lon"), F.col("o.lat"), F.col("o.lon")).alias("apart")).where("apart < 6000"))

    evidence = Evidence(cand)
    edges = cand.withColumn("support", F.lit(-1))
    best_of = Window.partitionBy("bid").orderBy(F.desc("p"), "aid")
    seen: set = set()
    while True:
        judged = evidence.judged(edges)
        best = materialize(judged.withColumn("r", F.row_number().over(best_of)).where((F.col("r") == 1) & (F.col("p") > least)).select("bid", "aid", "p", "alat", "alon"))
        now = tuple(best.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("bid", "aid"), F.lit(2**31)))).first())
        if now in seen:  # no partner has changed, or the same partners come round again
            return best.select(F.col("bid").alias(left_id), F.col("aid").alias(right_id), F.col("p").alias("confidence"))
        partner = best.select(F.col("bid").alias("nid"), F.col("alat").alias("plat"), F.col("alon").alias("plon"), F.col("p").alias("trust"))
        # partners of neighbours should lie as far from the candidate as the neighbours from the record
        off = F.abs(haversine(F.col("alat"), F.col("alon"), F.col("plat"), F.col("plon")) - F.col("apart"))
        agree = F.sum(F.col("trust") * F.exp(-off / 1000.0)) / F.sum("trust")
        support = cand.join(near, "bid").join(partner, "nid").where("plat is not null and alat is not null").groupBy("aid", "bid").agg(agree.alias("r"))
        fresh = materialize(cand.join(support, ["aid", "bid"], "left").select(*cand.columns, _degree(F.col("r"), SUPPORT_STEPS).alias("support")))
        if seen:
            discard(edges.sparkSession, edges)
        discard(best.sparkSession, best)
        seen.add(now)
        edges = fresh
        evidence.learn_support(edges)
