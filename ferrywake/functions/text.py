"""Names, keys, labels and classes as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def station_name(name: Column) -> Column:
    """Station name without adornments and punctuation, for comparing."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+(underground|dlr|rail)?\s*station\b.*$", " "), r"\s+platform\b.*$", " ")
    bare = F.regexp_replace(F.regexp_replace(cut, "['`‘’]", ""), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def location_arm(location: Column, next_stop: Column) -> Column:
    """'at' or 'approaching' if the reported location names the train's own next stop."""
    near, at = F.regexp_extract(location, r"(?i)^\s*approaching\s+(.+)$", 1), F.regexp_extract(location, r"(?i)^\s*at\s+(.+)$", 1)
    target = station_name(F.when(near != "", near).otherwise(at))
    return F.when((target != "") & (target == station_name(next_stop)), F.when(near != "", "approaching").otherwise("at"))


def direction(raw: Column) -> Column:
    """1/2 and words to outbound/inbound, blank to unknown."""
    d = F.lower(F.trim(raw))
    return F.when(d == "", "unknown").when(d == "1", "outbound").when(d == "2", "inbound").otherwise(d)


def humanized(name: Column) -> Column:
    return F.trim(F.replace(name, F.lit("_"), F.lit(" ")))  # F15


def safe_key(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9_.-]", "_")  # F16


def segment_key(line: Column, branch: Column, way: Column, index: Column) -> Column:
    return F.concat_ws(":", line, branch.cast("string"), way, index.cast("string"))  # F23


def with_flag(vessels: DataFrame, mids: DataFrame, mmsi: str = "mmsi") -> DataFrame:
    """Flag from the maritime identification digits (F24). ``mids`` (``mid`` int, ``flag``) is a reference table of a few hundred rows by definition."""
    digits = F.floor(F.col(mmsi) / 1_000_000).cast("int")
    known = mids.where("mid between 100 and 999").groupBy(F.col("mid").cast("int").alias("_mid")).agg(F.min("flag").alias("_flag"))
    names = F.broadcast(known)  # three digits: at most 900 rows
    return vessels.withColumn("_m", digits).join(names, F.col("_m") == F.col("_mid"), "left").withColumn("flag", F.coalesce("_flag", F.lit("Unknown"))).drop("_m", "_mid", "_flag")


def ship_class(kind: Column) -> Column:
    """Class of an AIS ship type."""
    t = F.coalesce(kind, F.lit(0))
    ranged = F.when(t.between(60, 69), "pass").when(t.between(70, 79), "cargo").when(t.between(80, 89), "tanker")
    return ranged.when(t == 30, "fish").when(t.isin(36, 37), "pleasure").when(t.between(50, 55), "special").otherwise("other")


# Registrations and callsign prefixes of emergency helicopters.
POLICE_MARKS = ("G-MPSA", "G-MPSB", "G-MPSC", "G-NPAS", "G-NPAA", "G-NPAB", "G-NPAC", "G-POLA", "G-POLD", "G-POLF", "G-POLH", "G-POLU", "G-CPAO", "G-CPAS", "G-LASU")
POLICE_MARK_STARTS = ("G-POL", "G-MPS", "G-NPA")
AMBULANCE_MARKS = ("G-LAAA", "G-LAAB", "G-KSST", "G-KSSC", "G-LNAC", "G-EHAT", "G-EHEM")
AMBULANCE_MARK_STARTS = ("G-LAA", "G-KSS")
POLICE_CALLS = ("NPAS", "POL")
AMBULANCE_CALLS = ("HLE", "HEMS", "HMED", "HELIMED", "MEDIC")


def emergency_kind(registration: Column, callsign: Column) -> Column:
    """'police', 'air-ambulance' or null: registration before callsign, police before ambulance."""
    reg = F.trim(F.upper(F.coalesce(registration, F.lit(""))))
    call = F.regexp_replace(F.upper(F.coalesce(callsign, F.lit(""))), "[^A-Z0-9]", "")
    starts = lambda c, ps: F.lit(False) if not ps else c.rlike("^(" + "|".join(map(re.escape, ps)) + ")")
    by_mark = F.when(reg.isin(*POLICE_MARKS) | starts(reg, POLICE_MARK_STARTS), "police").when(reg.isin(*AMBULANCE_MARKS) | starts(reg, AMBULANCE_MARK_STARTS), "air-ambulance")
    by_call = F.when(starts(call, POLICE_CALLS), "police").when(starts(call, AMBULANCE_CALLS), "air-ambulance")
    return F.coalesce(by_mark, by_call)


def aircraft_class(registration: Column, callsign: Column, category: Column) -> Column:
    """Emergency kind, else helicopter (category A7), else plane."""
    return F.coalesce(emergency_kind(registration, callsign), F.when(category == "A7", "helicopter").otherwise("plane"))


def flying(lat: Column, lon: Column, category: Column) -> Column:
    """Aircraft with a position that is no ground vehicle or obstacle."""
    return lat.isNotNull() & lon.isNotNull() & ~F.coalesce(category.startswith("C"), F.lit(False))


def short_operator(name: Column, initials: dict[str, str]) -> Column:
    """Operator's initials, else its trimmed name, 'NR' for a blank one (F27); ``initials`` is a small lookup."""
    t = F.trim(name)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in initials.items() for x in kv]), t) if initials else F.lit(None).cast("string")
    return F.when(F.coalesce(t, F.lit("")) == "", "NR").otherwise(F.coalesce(known, t))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")  # T6


def altitude_label(feet: Column, on_ground: Column) -> Column:
    return F.when(on_ground, "on ground").otherwise(F.concat(F.format_number(F.round(feet, 0), 0), F.lit(" ft")))  # F29


def dimensions_line(length_m: Column, width_m: Column, draught_m: Column) -> Column:
    """Length, width and draught, as far as they are known (F29); null if none is."""
    size = F.when(length_m.isNotNull() & width_m.isNotNull(), F.concat(length_m.cast("string"), F.lit(" × "), width_m.cast("string"), F.lit(" m"))).otherwise(F.concat(length_m.cast("string"), F.lit(" m long")))
    return F.nullif(F.concat_ws(" · ", size, F.concat(F.lit("draught "), draught_m.cast("string"), F.lit(" m"))), F.lit(""))


def flag_line(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit("Unknown")) != "Unknown", F.concat(F.lit("Flag: "), flag))  # F29


def countdown_label(tts: Column) -> Column:
    """Minutes and seconds left (F28); 'due' at zero."""
    return F.when(tts <= 0, "due").otherwise(F.format_string("%d:%02d", F.floor(tts / 60).cast("int"), F.floor(F.pmod(tts, F.lit(60))).cast("int")))


def due_label(tts: Column) -> Column:
    return F.when(tts < 45, "due").otherwise(F.concat(half_up(tts / 60.0).cast("string"), F.lit(" min")))  # F28


def bikes_label(bikes: Column, docks: Column, renting: Column) -> Column:
    """Availability in words."""
    many = lambda n, word: F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))
    return (
        F.when(~F.coalesce(renting, F.lit(False)), "not renting")
        .when(bikes == 0, F.concat(F.lit("no bikes · "), many(docks, "space"), F.lit(" to return one")))
        .when(docks == 0, F.concat(many(bikes, "bike"), F.lit(" · no space to return")))
        .otherwise(F.concat(many(bikes, "bike"), F.lit(" · "), many(docks, "space")))
    )


def bikes_class(bikes: Column, renting: Column) -> Column:
    """closed, empty, low (at most 3) or ok."""
    return F.when(~F.coalesce(renting, F.lit(False)), "closed").when(bikes == 0, "empty").when(bikes <= 3, "low").otherwise("ok")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def present(value: Column) -> Column:
    """Whether a facility value means that it is there."""
    v = F.lower(F.trim(value))
    return F.coalesce(~v.isin("", "no", "0", "none"), F.lit(False))


def first_values(pairs: Column) -> Column:
    """Map from an array of (key, value) structs in which the first of equal keys wins."""
    fresh = F.filter(pairs, lambda p, i: p["key"].isNotNull() & ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(fresh)


def facilities(props: Column) -> Column:
    """Labels of a station's facilities from (category, key, value) structs, first value of a key wins."""
    mine = F.transform(F.filter(props, lambda p: (p["category"] == "Facility") & p["value"].isNotNull()), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    m = first_values(mine)
    lifts = F.regexp_extract(F.coalesce(F.try_element_at(m, F.lit("Lifts")), F.lit("")), r"^\s*(\d+)", 1)
    labels = F.array(
        F.when(F.lower(F.trim(F.try_element_at(m, F.lit("WiFi")))) == "yes", "WiFi"),
        F.when(present(F.try_element_at(m, F.lit("Toilets"))), "Toilets"),
        F.when((lifts != "") & (lifts.try_cast("int") > 0), F.concat(F.lit("Lifts ×"), lifts.try_cast("int").cast("string"))),
        F.when(present(F.try_element_at(m, F.lit("Car park"))), "Car park"),
    )
    return F.array_compact(labels)


def crowding_percent(available: Column, fraction: Column) -> Column:
    return F.when(available, half_up(fraction * 100))  # F30


# Colours of severities.
SEVERITY_COLOURS = {"Severe": "#d43", "Serious": "#d43", "Moderate": "#da3"}
OTHER_SEVERITY = "#8a94a0"


def severity_colour(severity: Column, colours: dict[str, str] = SEVERITY_COLOURS, default: str = OTHER_SEVERITY) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), severity), F.lit(default))  # F32


def localized_name(raw: Column) -> Column:
    """A name given as JSON text: a string, or an array of (text, language) that prefers English."""
    many = F.from_json(raw, "array<struct<text:string,language:string>>")
    texts = F.filter(many, lambda e: e["text"].isNotNull())
    english = F.filter(texts, lambda e: e["language"] == "en")
    listed = F.coalesce(F.try_element_at(english, F.lit(1))["text"], F.try_element_at(texts, F.lit(1))["text"])
    one = F.when(F.trim(raw).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])
    name = F.trim(F.when(F.trim(raw).startswith("["), listed).otherwise(one))
    return F.nullif(name, F.lit(""))


def dimension(a: Column, b: Column) -> Column:
    return F.nullif(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.lit(0))  # F42


def delayed(etd: Column) -> Column:
    """An estimate that is a word other than 'On time' (F41)."""
    return F.coalesce((etd != "On time") & ~etd.rlike(r"^\d"), F.lit(False))


def eta_minutes(next_ms: Column, now_ms: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), half_up((next_ms - now_ms) / 60_000.0))  # F41


def rank_line(rank: Column, total: Column, mode: Column) -> Column:
    return F.format_string("#%d of %d %s today", rank.cast("int"), total.cast("int"), mode)  # F43


def live_identity(vehicle_id: Column) -> Column:
    return F.coalesce((vehicle_id != "") & (vehicle_id != "000"), F.lit(False))  # P4


def live_location(location: Column) -> Column:
    return F.coalesce((F.trim(location) != "") & ~location.rlike(r"(?i)sidings?\b"), F.lit(False))  # P4


def mode_of(public: Column) -> Column:
    """Public mode names to entry modes (P6), null for any other name."""
    return F.when(public == "train", "tube").when(public.isin("bus", "ship"), public)


# Forms of request parameters.
PARAMETERS = {"line": r"[a-z0-9-]+", "naptan": r"[A-Za-z0-9]{4,20}", "vehicle": r"[A-Za-z0-9-]{1,20}", "crs": r"[A-Za-z]{3}", "mmsi": r"\d{9}", "callsign": r"[A-Za-z0-9-]{2,10}"}


def valid_lines(raw: str, most: int = 30) -> list[str]:
    """Comma-separated line ids: each valid (an empty one isn't), at most ``most`` as given; returned distinct and sorted."""
    ids = [x.strip() for x in raw.split(",")]
    if len(ids) > most or any(not re.fullmatch(PARAMETERS["line"], x) for x in ids):
        raise ValueError(f"expected 1 to {most} line ids, got {raw!r}")
    return sorted(set(ids))


def valid(kind: str, value: Column) -> Column:
    return F.coalesce(value.rlike("^(?:" + PARAMETERS[kind] + ")$"), F.lit(False))  # P7


def place_key(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", F.format_string("%.3f", lat), F.format_string("%.3f", lon))  # P7


def camera_rows(cameras: DataFrame) -> DataFrame:
    """Traffic cameras that have an image and aren't unavailable, without the id's prefix (P9). Properties: array of (key, value), the last of equal keys wins."""
    keyed = cameras.withColumn("_m", F.map_from_entries(F.filter("properties", lambda p, i: p["key"].isNotNull() & ~F.exists(F.slice(F.col("properties"), i + 2, F.size("properties")), lambda q: q["key"] == p["key"]))))
    good = (F.coalesce(F.try_element_at("_m", F.lit("available")), F.lit("")) != "false") & F.try_element_at("_m", F.lit("imageUrl")).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return keyed.where(good).select(F.regexp_replace("id", "^JamCams?_", "").alias("id"), "lat", "lon", F.try_element_at("_m", F.lit("imageUrl")).alias("image_url"), F.try_element_at("_m", F.lit("view")).alias("view"))


def line_label(line: Column) -> Column:
    return F.upper(F.trim(line))  # P10


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, " (Underground|Rail|DLR) Station$", "")  # P13


def natural_key(line: Column) -> list[Column]:
    """Sort columns for a numeric-aware order."""
    return [F.regexp_extract(line, r"^(\d+)", 1).try_cast("long").asc_nulls_last(), line.asc()]
