from ferrywake.llm.mojibake import garbled_documents

CLEAN = ["Der Zug nach München fällt aus – bitte über Köln fahren.", "Le café près de l’église est fermé.", "Próxima estación: España.", "Поезд задерживается на пять минут.", "Fares from £3 – it’s 12°C.", "SERVIÇO SÓ ATÉ À ESTAÇÃO – NÃO HÁ LIGAÇÃO.", "Pociąg opóźniony – zażółć gęślą jaźń."] * 30


def found(spark, texts):
    df = spark.createDataFrame([(n, t, True, "x") for n, t in enumerate(texts)], "doc_id long, text string, lost boolean, doc string")
    return {r.doc_id: r for r in garbled_documents(df, "doc_id", "text").collect()}


def test_all_kinds(spark):
    good = "Der Zug nach München fällt aus – bitte über Köln fahren."
    wrong = [good.encode("utf-8").decode(e, "replace") for e in ("latin-1", "mac_roman", "cp437", "cp850")]
    wrong.append(good.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"))
    wrong.append("Le café est là. " + "Le café près de l’église est fermé.".encode().decode("cp1252"))
    wrong.append("Der Zug nach M�nchen")
    single = "Le café près de l’église est fermé.".encode("mac_roman").decode("cp437")
    out = found(spark, CLEAN + wrong + [single])
    n = len(CLEAN)
    assert sorted(out) == list(range(n, n + 8))
    assert all(out[n + k].restored == good for k in range(5))
    assert out[n + 5].restored == "Le café est là. Le café près de l’église est fermé."
    assert out[n + 6].lost and out[n + 7].single_runs > 0 and out[n + 7].restored == "Le café près de l’église est fermé."


def test_what_is_no_case(spark):
    odd = ["", " ", None, "plain", "Caf&eacute; &amp; bar", "caf%C3%A9", "┌──┬──┐\n│ a │ b │\n└──┴──┘", "SÃO PAULO", "x" * 300_000 + " café"]
    assert found(spark, CLEAN + odd) == {}


def test_escaped_after_garbling(spark):
    out = found(spark, CLEAN + ["Paid &Acirc;&pound;3 at the caf&Atilde;&copy;"])
    assert len(out) == 1 and out[len(CLEAN)].restored == "Paid £3 at the café"


def test_long_text_is_read_to_its_end(spark):
    out = found(spark, CLEAN + ["Köln " * 60_000 + "MÃ¼nchen"])
    assert out[len(CLEAN)].restored.endswith("München")


def test_empty(spark):
    assert found(spark, []) == {}


def test_copies_of_a_garbled_text_prove_nothing(spark):
    good = "Le café près de l’église est fermé."
    single = good.encode("mac_roman").decode("cp437")
    multi = "Próxima estación: España.".encode().decode("latin-1")
    out = found(spark, CLEAN + [f"{t} {k}" for k, t in enumerate(CLEAN)] + [single] * 200 + [multi] * 200)
    assert sorted(out) == list(range(2 * len(CLEAN), 2 * len(CLEAN) + 400))
    assert out[2 * len(CLEAN)].restored == good and out[2 * len(CLEAN) + 200].restored == "Próxima estación: España."


def test_texts_of_a_garbling_source_prove_nothing(spark):
    multi = "Próxima estación: España.".encode().decode("latin-1")
    out = found(spark, [f"{t} {k}" for k, t in enumerate(CLEAN)] + [f"{multi} {k}" for k in range(2000)])
    assert sorted(out) == list(range(len(CLEAN), len(CLEAN) + 2000))


SCRIPTS = {
    "greek": "Το τρένο φεύγει τώρα από την πλατφόρμα.", "arabic": "القطار متأخر خمس دقائق", "hebrew": "הרכבת מאחרת בחמש דקות", "vietnamese": "Tàu đến chậm năm phút, xin quý khách chờ.", "japanese": "電車は五分遅れています。", "korean": "열차가 오 분 늦습니다.", "emoji": "Delay 🚆 sorry 🚌 thanks 🙏",
    "thai": "รถไฟล่าช้าห้านาที", "russian": "Поезд задерживается на пять минут.",
}


def test_all_scripts_come_back_whole(spark):
    texts, want = list(CLEAN) + list(SCRIPTS.values()) * 20, {}
    for script, good in SCRIPTS.items():
        for wrong in ("latin-1", "cp437", "cp850", "mac_roman", *(() if script == "arabic" else ("koi8-r",))):  # there two letters become a Russian syllable
            want[len(texts)] = good
            texts.append(good.encode().decode(wrong))
    out = found(spark, texts)
    assert sorted(out) == sorted(want)
    assert {k: r.restored for k, r in out.items()} == want


def test_encodings_of_several_bytes(spark):
    good = "列车晚点五分钟，请注意。"
    texts = CLEAN + [good] * 20 + ["It’s five minutes late".encode().decode("gb18030"), SCRIPTS["japanese"].encode("shift_jis").decode("cp1252", "ignore")]
    texts += [good.encode().decode("gb18030", "replace"), SCRIPTS["japanese"]] + [SCRIPTS["japanese"]] * 20 + [SCRIPTS["japanese"].encode("euc_jp").decode("latin-1")]
    out = found(spark, texts)
    n = len(CLEAN) + 20
    assert n in out and out[n].restored == "It’s five minutes late" and out[len(texts) - 1].restored == SCRIPTS["japanese"]
    assert not set(out) & set(range(n)) and not set(out) & set(range(n + 3, len(texts) - 1))


def test_half_known_sequences_are_reported_and_left(spark):
    text = "cafÃ©\u0081 late"
    out = found(spark, CLEAN + [text])
    assert out[len(CLEAN)].restored == text
