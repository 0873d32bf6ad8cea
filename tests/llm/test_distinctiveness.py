import math

from folioscope.llm import distinctiveness as di


def test_occurrences():
    assert di.occurrences("fuel, fuels; (fuel) 2fuel fuel", "fuel") == [0, 14, 26]
    assert di.occurrences("αfuelβ", "fuel") == [1]
    assert di.occurrences("", "fuel") == []


def test_degrees():
    text = "Dense fuel burns. Dense FUEL burns! A dense fuel cools slowly over night."
    assert list(di.degrees(text, ["dense fuel", "night", "absent"], 2)) == [("dense fuel", 3, 6), ("night", 1, 2), ("absent", 0, 0)]


def brute(terms, texts):
    records = {r for r, _ in texts if r is not None}
    held = {(r, t.strip().lower()) for r, t in terms if r is not None and t and t.strip()}
    out = {}
    for r, text in texts:
        for q, t in held:
            if r == q and text is not None:
                _, n, degree = next(iter(di.degrees(text, [t], 4)))
                df = sum(1 for _, x in held if x == t)
                out[r, t] = max(out.get((r, t), (-1,)), (n, degree, df, degree * math.log(len(records) / df)))
    return out


def test_scores(spark, monkeypatch):
    terms = [("a", "Fuel"), ("a", " fuel "), ("b", "fuel"), ("b", "sand"), ("c", "sand"), ("d", None), ("d", "  "), (None, "fuel"), ("a", "ash"), ("e", "fuel")]
    terms += [("b", f"word{i}") for i in range(30)]
    texts = [("a", "fuel and ash and fuel"), ("b", "Sand, FUEL word3 word4."), ("b", "fuel fuel"), ("c", None), ("d", "fuel"), ("e", ""), (None, "fuel"), ("f", "x " * 20_000)]
    left = spark.createDataFrame([(*t, "x") for t in terms], "eid string, keyword string, score string")
    right = spark.createDataFrame(texts, "eid string, abstract string")
    want = brute(terms, texts)
    for at_once in (512, 4):
        monkeypatch.setattr(di, "TERMS_AT_ONCE", at_once)
        found = {(r.eid, r.keyword): (r.occurrences, r.degree, r.records, r.score) for r in di.score_terms(left, right, "eid", "keyword", "abstract").collect()}
        assert found.keys() == want.keys()
        assert all(found[k][:3] == want[k][:3] and abs(found[k][3] - want[k][3]) < 1e-9 for k in want)
    assert di.score_terms(left.where("false"), right.where("false"), "eid", "keyword", "abstract").count() == 0
