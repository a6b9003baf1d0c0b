from ferrywake.operators.delivery import keep_first_delivery, new_messages, repeated_deliveries

SCHEMA = "delivery_id long, i string, t long, l string, _order string, _salt int, _row string"


def rows(spark, data):
    return spark.createDataFrame([(*r, None, "x", 1, "y") for r in data], SCHEMA)


def test_repeats_ties_nulls(spark):
    df = rows(spark, [(1, "a", 10), (2, "a", 10), (3, "a", 11), (4, None, 10), (5, None, 10), (6, "b", None), (7, "a", 10), (8, "", 0), (9, "", 0)])
    assert sorted(r.delivery_id for r in repeated_deliveries(df, ["i", "t"], "delivery_id", salts=2).collect()) == [2, 7, 9]
    kept = keep_first_delivery(df, ["i", "t"], "delivery_id", salts=2)
    assert kept.columns == df.columns
    assert sorted(r.delivery_id for r in kept.collect()) == [1, 3, 4, 5, 6, 8]


def test_same_row_twice_is_kept_once(spark):
    df = rows(spark, [(1, "a", 10), (1, "a", 10)])
    assert keep_first_delivery(df, ["i", "t"], "delivery_id").count() == 1


def test_one_hot_message(spark):
    df = rows(spark, [(n, "hot", 1) for n in range(500)] + [(1000 + n, f"k{n}", 1) for n in range(50)])
    found = {r.delivery_id for r in repeated_deliveries(df, ["i", "t"], "delivery_id", salts=8).collect()}
    assert found == set(range(1, 500))


def test_new_batches(spark):
    stored = rows(spark, [(1, "a", 1), (2, None, 1)])
    batch = rows(spark, [(5, "a", 1), (6, "b", 1), (7, "b", 1), (8, None, 1)])
    assert sorted(r.delivery_id for r in new_messages(stored, batch, ["i", "t"], "delivery_id").collect()) == [6, 8]


def test_empty(spark):
    df = rows(spark, [])
    assert repeated_deliveries(df, ["i", "t"], "delivery_id").count() == 0
    assert keep_first_delivery(df, ["i", "t"], "delivery_id").count() == 0
    assert new_messages(df, df, ["i", "t"], "delivery_id").count() == 0
