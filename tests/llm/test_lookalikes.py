from folioscope.llm import lookalikes


def test_unify_kinds():
    text, counts = lookalikes.unify("ＡＢ ﬁrst é a​b c d")
    assert text == "AB first é ab c d"
    assert counts == {"wide": 2, "joined": 1, "accents": 1, "invisible": 1, "spaces": 1}
    assert lookalikes.unify("plain\ttext\n")[1] == {}
    assert lookalikes.unify("中文，测试。“quoted” – naïve m² … α")[1] == {}
    assert lookalikes.unify("wide，comma")[1] == {"wide": 1}


def test_mixed_tokens():
    assert [w for _, _, w in lookalikes.mixed_tokens("mоdel αβ 5 μm Москва α-helix naïve pɑper")] == ["model", "paper"]


def test_repair(spark):
    rows = [(1, "a clean model of text"), (2, "another mоdel here"), (3, "the Сzqx thing"), (4, None), (5, ""), (6, "Привет мир"), (2, "again mоdel"), (7, "ｗｉｄｅ")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, wide int")
    found = sorted((r.id, r.clean, r.repaired, r.unresolved, r.wide) for r in lookalikes.repair(frame, "id", "text").collect())
    assert found == [(2, "again model", 1, 0, 0), (2, "another model here", 1, 0, 0), (3, "the Сzqx thing", 0, 1, 0), (7, "wide", 0, 0, 4)]
    assert lookalikes.repair(frame.where("false"), "id", "text").count() == 0


def test_letters_outside_the_table(spark):
    texts = ["a ʙook", "the wʜole", "ᴀnother", "a ɹed one", "mѐtal here", "ѓood", "a 𝐦odel", "moԃel", "5 μm λmax xⁿ donʼt Δt", "Приветz", "使用model", "book whole another red"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = sorted((r.id, r.clean, r.repaired, r.unresolved) for r in lookalikes.repair(frame, "id", "text").collect())
    assert found == [(i, texts[i], 0, 1) for i in range(8)]


def test_dominant_script(spark):
    assert lookalikes.dominant_script("привеt") == "CYRILLIC" and lookalikes.dominant_script("tо") == lookalikes.dominant_script("ʙook") == "LATIN"
    rows = [
        (1, "сказал привеt всем"), (2, "слово привет"), (3, "Москвa"), (4, "раураl here"), (5, "plain paypal"), (6, "нечтo"), (7, "a mоdel zоzq"), (8, "some model"),
    ]
    frame = spark.createDataFrame(rows, "id long, text string")
    found = {r.id: (r.clean, r.repaired, r.restored, r.unresolved) for r in lookalikes.repair(frame, "id", "text").collect()}
    # towards the dominant script if that is a known word, else towards Latin if that is; a foreign word that is neither is left alone
    assert found == {
        1: ("сказал привет всем", 0, 1, 0), 3: ("Москвa", 0, 0, 0), 4: ("paypal here", 1, 0, 0), 6: ("нечтo", 0, 0, 0), 7: ("a model zоzq", 1, 0, 1),
    }


def test_vocabulary_decides(spark):
    frame = spark.createDataFrame([(1, "a mоdel"), (2, "the model")], "id long, text string")
    assert [r.repaired for r in lookalikes.repair(frame, "id", "text").collect()] == [1]
    assert [(r.repaired, r.unresolved) for r in lookalikes.repair(frame.where("id = 1"), "id", "text").collect()] == [(0, 1)]
