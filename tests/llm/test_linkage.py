from ferrywake.llm.linkage import link

STATIONS = [("AAA", "Kelford Junction", 51.50, 0.10), ("BBB", "St. Mora's Gate", 51.52, 0.12), ("CCC", "Harnby", 51.40, 0.30), ("DDD", "Harnby", 51.60, -0.30), ("EEE", "Pelton & Wexham", 51.45, -0.10), ("EEE", "PELTON & WEXHAM", None, -0.10), ("FFF", "Ludgate North", 51.70, 0.05), ("GGG", "Marford", 51.30, 0.0)]


def links(spark, rows, stations=STATIONS):
    left = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "id string, name string, lat double, lon double, rid string, w double")
    right = spark.createDataFrame([(*r, 1) for r in stations], "crs string, name string, lat double, lon double, rid int")
    return {r.id: (r.crs, r.confidence) for r in link(left, "id", "name", "lat", "lon", right, "crs", "name", "lat", "lon").collect()}


def test_noise_namesakes_and_strangers(spark):
    rows = [
        ("1", "KELFORD  JUNCTION Rail Station", 51.5005, 0.1003), ("1", "Kelford Junction", 51.5005, 0.1003), ("2", "St Moras Gaet (Line A)", 51.5201, 0.1199), ("3", "Harnby Station", 51.6002, -0.3001), ("4", "Wexham & Pelton stn", 51.4501, -0.1002),
        ("5", "Ludgate N.", 0.0502, 51.7001), ("6", None, 51.30003, 0.00002), ("7", "Brackwell", 51.41, 0.29), ("8", "Harnby", None, None), ("9", None, None, None), ("10", "Marford", None, None), (None, "Marford", 51.3, 0.0), ("11", "", 10.0, 10.0),
    ]
    out = links(spark, rows)
    assert {k: v[0] for k, v in out.items()} == {"1": "AAA", "2": "BBB", "3": "DDD", "4": "EEE", "5": "FFF", "6": "GGG", "10": "GGG"}
    assert all(0.5 <= c <= 1 for _, c in out.values())


def test_empty(spark):
    assert links(spark, []) == {} and links(spark, [("1", "a", 1.0, 1.0)], []) == {}


def test_namesakes_without_place(spark):
    # as many as there are, linked to the one station of that name; of two stations of one name neither can be told
    for n in (61, 6_000):
        rows = [(f"d{k}", "Zuxwick Parva", None, None) for k in range(n)] + [("e", "Harnby", None, None), ("f", "Kelford Jn", 51.5, 0.1001)]
        out = links(spark, rows, [*STATIONS, ("ZUX", "Zuxwick Parva", 51.1, 0.2)])
        assert {k: v[0] for k, v in out.items()} == {f"d{k}": "ZUX" for k in range(n)} | {"f": "AAA"}


def test_attributes_that_are_common_on_both_sides(spark):
    # every word, trigram and cell is shared by too many records of both sides; two attributes together still find the partner
    stations = [(f"S{i}-{j}", f"Alpha{i:02d} Beta{j:02d}", 51.5, 0.1) for i in range(12) for j in range(12)]
    rows = [(f"d{i}-{j}", f"Alpha{i:02d} Beta{j:02d}", None, None) for i in range(12) for j in range(12)]
    left = spark.createDataFrame(rows, "id string, name string, lat double, lon double")
    right = spark.createDataFrame(stations, "crs string, name string, lat double, lon double")
    out = {r.id: r.crs for r in link(left, "id", "name", "lat", "lon", right, "crs", "name", "lat", "lon", rare=4).collect()}
    assert sum(out.get(i) == "S" + i[1:] for i, *_ in rows) >= 0.98 * len(rows)
