from ferrywake.llm.tokens import count_tokens, load_encoding, with_tokens


def test_whole_texts(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, "", "b"), (3, None, None), (4, "é" * 5000, "c")], "doc_id long, text string, tokens string")
    out = {r.doc_id: r.tokens for r in with_tokens(df, "doc_id", "text").collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 1000


def test_pieces_sum_up():
    e = load_encoding()
    text = "The last departure leaves at 14:34, not 00:12; ask at Salton Road.\n" * 4000
    assert count_tokens(e, text) == len(e.encode_ordinary(text))
