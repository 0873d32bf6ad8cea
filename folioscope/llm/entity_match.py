"""References matched to the documents they cite, without a common key and with a confidence.

Both sides are brought to the same noisy attributes (DOI, title, year, surnames), and rows alike in all of them become one class.
Blocking: a class gets keys from MinHash values of its title's words (but those in many titles) and of its surnames taken
together, from the title's beginning with a surname, from its surnames with the year, and from the DOI and its two halves; classes
that share a key are candidates, in blocks of any size.  With `split` a key that more than CROWD classes of each side have would make candidates of very many that agree
in nothing else is split: by pairs of title words (of the twelve with the least hashes, the only word of a short title,
the surnames where there is no title), or, where the key is the title itself, by surnames. Its classes are candidates if they agree in
one of these too. Equal DOIs are never split.
Candidates meet at home: a document lies at the home of its first surname and at that of its least one, and a reference is sent once to each home
where it has candidates, with the list of them. So attributes are shuffled for each of a reference's few homes (more only where a home is dealt)
and not for each candidate, of which only three numbers are.
Features: edit similarity of titles and of the shorter one with the beginning of the longer, words without a
counterpart, added text, difference of years, shared surnames.

Weak labels come from the candidates whose two DOIs are known: equal DOIs match, clearly different ones don't.  A logistic
classifier learns the other attributes from a bounded sample of them (`sample` rows of each label) and is calibrated on the half
it hasn't seen; what DOIs say is then measured on the pairs the classifier is sure of, and added to its log-odds.

Cases: any attribute may be null; a side with neither DOI, title nor surnames has no keys and no candidates; without weak labels
of both kinds the prior weights are used; repeated rows and copies of documents are matched each; empty tables match nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.skew import HOT_KEYS, join_counted
from folioscope.llm.canonical import NO_TITLE
from folioscope.runtime import durable

_DOI = r"10\.\d{3,9}\s*/\s*[^\s?#]+"
_YEAR = r"\(((?:1[89]|20)\d\d)\)"
_ROWS = 4
#: Classes of each side that a block may have before `split` splits it.
CROWD = 200
#: Tasks that the rows of one large class are dealt to.
_SALTS = 32


def doi_key(column: Column) -> Column:
    """A DOI without what is written before or behind it, its case and its punctuation but the one dot that ends its first half."""
    found = F.regexp_extract(F.lower(column), _DOI, 0)
    clean = F.rtrim(F.regexp_replace(found, r"[^a-z0-9./]", ""), F.lit("./"))
    return F.when(clean != "", clean)


def spaced(column: Column) -> Column:
    """Lower-case letters and digits of a text, its words one space apart; null for nothing and for placeholders."""
    out = F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))
    return F.when((out != "") & ~F.replace(out, F.lit(" "), F.lit("")).isin(*NO_TITLE), out)


def _joined(column: Column) -> Column:
    return F.replace(column, F.lit(" "), F.lit(""))


def _words(column: Column) -> Column:
    """Distinct words of four letters or more of a spaced text."""
    return F.coalesce(F.array_distinct(F.filter(F.split(column, " "), lambda w: F.length(w) > 3)), F.array().cast("array<string>"))


def _surname(column: Column) -> Column:
    return F.regexp_extract(F.lower(column), r"^\s*([^\s,;]+)", 1)


def _hashes(values: Column, salt: int) -> Column:
    return F.array_min(F.transform(values, lambda v: F.xxhash64(F.lit(salt), v)))


def reference_side(references: DataFrame, id_cols: list[str], doi: str, title: str, year: str, authors: str, raw: str) -> DataFrame:
    """References as (ids, doi, title, years, names, first); what a field lacks is read from the whole reference."""
    given = lambda c: F.when(F.length(F.trim(F.col(c))) > 0, F.col(c))
    text = references.select(*id_cols, doi_key(F.col(doi)).alias("doi"), F.coalesce(given(title), F.col(raw)).alias("text"), F.col(raw).alias("raw"), given(authors).alias("authors"), F.col(year).cast("int").alias("year"))
    cut = lambda c, group: F.when(F.contains(c, F.lit("(")), F.regexp_extract(c, rf"(?s)^(.*?){_YEAR}(.*)$", group))
    parts = text.select("*", cut(F.col("text"), 2).alias("year_in"), cut(F.col("raw"), 2).alias("year_raw"))
    whole = F.col("year_in") != ""
    parts = parts.select(
        *id_cols, "doi", F.when(whole, cut(F.col("text"), 3)).otherwise(F.col("text")).alias("text"),
        F.array_sort(F.array_distinct(F.array_compact(F.array("year", F.col("year_in").try_cast("int"), F.col("year_raw").try_cast("int"))))).alias("years"),
        F.coalesce("authors", F.when(whole, cut(F.col("text"), 1)), cut(F.col("raw"), 1)).alias("authors"),
    )
    names = F.transform(F.split(F.regexp_replace(F.lower("authors"), r"\bet al\b\.?", ""), r"[,;]"), _surname)
    names = F.coalesce(F.filter(names, lambda n: (F.length(n) > 2) & ~n.rlike(r"^(\p{L}\.-?)+$")), F.array().cast("array<string>"))
    named = parts.select(*id_cols, "doi", spaced(F.col("text")).alias("title"), "years", names.alias("listed"))
    return named.select(*id_cols, "doi", "title", "years", F.array_sort(F.array_distinct("listed")).alias("names"), F.try_element_at("listed", F.lit(1)).alias("first"))


def document_side(documents: DataFrame, authors: DataFrame, id_col: str, record_col: str, doi: str, title: str, year: str, position: str, name: str) -> DataFrame:
    """Documents as (id, doi, title, years, names, first)."""
    listed = authors.select(F.col(record_col).alias("rec"), F.col(position).alias("pos"), _surname(F.col(name)).alias("n")).where("rec is not null and n <> ''")
    names = listed.groupBy("rec").agg(F.array_sort(F.collect_set("n")).alias("names"))
    first = listed.groupBy("rec").agg(F.min_by("n", "pos").alias("first"))
    own = documents.select(
        F.col(id_col).alias("doc"), F.col(record_col).alias("rec"), doi_key(F.col(doi)).alias("doi"), spaced(F.col(title)).alias("title"), F.array_compact(F.array(F.col(year).cast("int"))).alias("years"),
    )
    return own.join(names, "rec", "left").join(first, "rec", "left").select("doc", "doi", "title", "years", F.coalesce("names", F.array().cast("array<string>")).alias("names"), "first")


_ATTRIBUTES = ["doi", "title", "years", "names", "first"]


def _classes(side: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with the signature of their class, the classes, and the number of rows."""
    marked = side.withColumn("sig", F.struct(F.xxhash64(*_ATTRIBUTES), F.xxhash64(F.lit(7), *_ATTRIBUTES)))
    marked = _written(marked, f"{label}-sides")
    rows = _written(marked.drop(*_ATTRIBUTES), f"{label}-rows")
    grouped = marked.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), *(F.any_value(a).alias(a) for a in _ATTRIBUTES))
    classes = _written(grouped.withColumn("cls", F.monotonically_increasing_id()), f"{label}-classes")
    _removed(marked)
    return rows, classes, rows.count()


def common_words(documents: DataFrame, share: float = 0.05) -> list[str]:
    """Title words in more than `share` of the documents; at most a title's mean number of words / `share` of them."""
    most = share * documents.count()
    words = documents.select(F.explode(_words(F.col("title"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r.w for r in words.where(F.col("n") > most).collect()]


_SAME_DOI, _TITLE, _TITLE_YEAR = 40, 50, 51


def _kind() -> Column:
    """The kind of a blocking key, which its last six bits tell."""
    return F.col("key").bitwiseAND(F.lit(63))


def _keys(classes: DataFrame, common: list[str], citing: bool, *also: str) -> DataFrame:
    """Blocking keys of each class: (cls, also, key); the last six bits of a key are its kind."""
    words = F.array_except(_words(F.col("title")), F.array(*map(F.lit, common)).cast("array<string>"))
    base = classes.select(
        "cls", *also, "doi", F.col("first"), F.explode_outer("years").alias("y"), _joined(F.col("title")).alias("title"), words.alias("words"), "names",
    )
    base = base.select(
        "cls", *also, "doi", "title", "y", "first", _hashes(F.col("names"), 200).alias("least_name"), F.when(F.size("names") > 0, F.xxhash64("names")).alias("all_names"),
        *(_hashes(F.col("words"), 100 + i).alias(f"w{i}") for i in range(_ROWS)), F.when(F.length("title") >= 6, F.substring("title", 1, 8)).alias("start"),
        F.regexp_extract("doi", r"^([^/]*/.*)\.[^.]*$", 1).alias("doi_head"), F.regexp_extract("doi", r"([^./]*)$", 1).alias("doi_tail"),
    )
    found = []

    def key(kind: int, *parts: Column) -> None:
        known = parts[0].isNotNull()
        for p in parts[1:]:
            known = known & p.isNotNull()
        found.append(F.when(known, F.xxhash64(F.lit(kind), *parts).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(kind))))

    for i, names in enumerate((F.col("least_name"), F.col("first"))):
        for j in range(_ROWS):
            key(10 + i, names, F.lit(j), F.col(f"w{j}"))
        key(20 + i, names, F.col("start"))
    key(30, F.col("all_names"), F.col("y"))
    key(_SAME_DOI, F.col("doi"))
    key(41, F.when(F.col("doi_head") != "", F.col("doi_head")))
    key(42, F.when(F.length("doi_tail") >= 6, F.col("doi_tail")))
    # a title without its authors must be long to say anything by itself
    long = F.length("title") >= 25
    key(_TITLE, F.when(long, F.col("title")))
    key(_TITLE_YEAR, F.when(long & F.col("first").isNull() if citing else long, F.substring("title", 1, 20)), F.col("y"))
    return base.select("cls", *also, F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("key"))


def _candidates(left: DataFrame, right: DataFrame, common: list[str]) -> DataFrame:
    """Pairs (rid, did) of classes that share a key, crowded blocks split by further attributes."""
    lk = _keys(left, common, True).withColumnRenamed("cls", "rid")
    rk = _keys(right, common, False).withColumnRenamed("cls", "did")
    many = rk.where(_kind() != _SAME_DOI).groupBy("key").agg(F.count(F.lit(1)).alias("nd")).where(F.col("nd") > CROWD)
    many = durable(many, "crowded-documents")
    if many.isEmpty():
        return lk.join(rk, "key").select("rid", "did").distinct()
    lk, rk = durable(lk, "reference-keys"), durable(rk, "document-keys")
    total = lk.count()
    counted = lk.join(many.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("nr")).where(F.col("nr") > CROWD)
    many = durable(counted.join(many, "key"), "crowded-blocks")
    hot = F.broadcast(many.where(F.col("nr") >= max(2, total // HOT_KEYS)).select("key"))
    usual = lk.join(hot, "key", "left_anti").join(many.select("key"), "key", "left_anti").join(rk, "key")
    parts = [
        join_counted(keys, many.select("key", n), ["key"], n, rows).join(_finer(side, common, name), name)
        for keys, side, name, n, rows in ((lk, left, "rid", "nr", total), (rk, right, "did", "nd", rk.count()))
    ]
    lf, rf = (
        part.select(name, "key", F.explode(F.when(_kind().isin(_TITLE, _TITLE_YEAR), F.col("by_names")).otherwise(F.col("by_words"))).alias("also")) for part, name in zip(parts, ("rid", "did"), strict=True)
    )
    return usual.select("rid", "did").unionByName(lf.join(rf, ["key", "also"]).select("rid", "did")).distinct()


def _finer(classes: DataFrame, common: list[str], name: str) -> DataFrame:
    """What a crowded block may be split by, as hashes: `by_words` and `by_names`."""
    words = F.transform(F.array_except(_words(F.col("title")), F.array(*map(F.lit, common)).cast("array<string>")), lambda w: F.xxhash64(w))
    least = F.slice(F.array_sort(words), 1, 12)
    both = F.flatten(F.transform(least, lambda x, i: F.transform(F.slice(least, i + 2, 12), lambda y: F.xxhash64(x, y))))
    names = F.when(F.size("names") > 0, F.transform("names", lambda n: F.xxhash64(F.lit("@"), n))).otherwise(F.array(F.lit(0).cast("long")))
    return classes.select(F.col("cls").alias(name), F.when(F.size(words) > 1, both).when(F.size(words) == 1, words).otherwise(names).alias("by_words"), names.alias("by_names"))


def _features(pairs: DataFrame) -> DataFrame:
    """Candidates with their features, as columns f0.. and the state of the DOIs in `dois`.

    Titles are alike by the share of their letters that agree, however long they are; words are compared one by one only where the
    titles are alike.
    """
    pairs = pairs.select("rid", "did", "r", "d", *(_joined(F.col(f"{x}.title")).alias(f"{x}t") for x in "rd"))
    pairs = pairs.withColumns({"nr": F.length("rt"), "nd": F.length("dt")}).withColumn("short", F.least("nr", "nd"))
    close = lambda e, n: F.when(e >= 0, 1 - e / n).otherwise(0.0)
    longer = F.col("nr") > F.col("nd") + 3
    head = [F.substring(F.col(t), F.lit(1), F.col("short")) for t in ("rt", "dt")]
    tail = [F.substring(F.col(t), F.col(n) - F.col("short") + 1, F.col("short")) for t, n in (("rt", "nr"), ("dt", "nd"))]
    pairs = pairs.select(
        "*", F.levenshtein(F.col("rt"), F.col("dt")).alias("e_whole"), F.when(F.col("nr") != F.col("nd"), F.levenshtein(*head)).alias("e_head"), F.when(longer, F.levenshtein(*tail)).alias("e_tail"),
        F.array_min(F.flatten(F.transform(F.col("r.years"), lambda x: F.transform(F.col("d.years"), lambda y: F.abs(x - y))))).alias("gap"),
        F.try_divide(F.size(F.array_intersect("r.names", "d.names")), F.least(F.size("r.names"), F.size("d.names"))).alias("shared"),
        F.levenshtein(F.col("r.doi"), F.col("d.doi"), 2).alias("near"), (F.col("r.doi").isNotNull() & F.col("d.doi").isNotNull()).alias("both"), (F.col("rt").isNotNull() & F.col("dt").isNotNull()).alias("known"),
    )
    whole, head_like = close(F.col("e_whole"), F.greatest("nr", "nd")), close(F.coalesce("e_head", "e_whole"), F.col("short"))
    pairs = pairs.withColumns({"best": F.greatest(whole, F.when(F.col("nr") < F.col("nd"), head_like).otherwise(whole)), "added": F.when(longer, F.greatest(head_like, close(F.col("e_tail"), F.col("short")))).otherwise(0.0)})
    missing = F.size(F.filter(_words(F.col("r.title")), lambda w: ~F.exists(_words(F.col("d.title")), lambda v: (v == w) | v.startswith(w) | (F.levenshtein(w, v, 2) >= 0))))
    pairs = pairs.withColumn("off", F.when(F.col("e_whole") == 0, 0).when(F.greatest("best", "added") > 0.7, F.least(missing, F.lit(4))).otherwise(4))
    names = (F.size("r.names") > 0) & (F.size("d.names") > 0)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    value = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    state = F.when(~F.col("both"), "unknown").when(F.col("r.doi") == F.col("d.doi"), "equal").when(F.col("near") >= 0, "near").otherwise("different")
    known, best, gap = F.col("known"), F.col("best"), F.col("gap")
    columns = [
        yes(known), value(F.when(known, best)), value(F.when(known & (best > 0.85), (best - 0.85) * 6)), value(F.when(known, 1 - F.col("short") / F.greatest("nr", "nd"))),
        yes(known & (F.col("added") > 0.85)), value(F.when(known, F.col("off"))), yes(gap == 0), yes(gap == 1), yes(gap > 1), yes(names & (F.col("shared") == 0)), value(F.when(names, F.col("shared"))),
    ]
    return pairs.select("rid", "did", state.alias("dois"), *(c.alias(f"f{i}") for i, c in enumerate(columns)))


_FEATURES = 11
#: Weights (first the constant) that stand where there is nothing to learn from.
_PRIOR = np.array([-6.0, -2.0, 4.0, 4.0, -0.5, -6.0, -1.0, 1.0, 0.0, -3.0, -5.0, 5.0])
_STATES = {"unknown": 0.0, "equal": 5.0, "near": 3.0, "different": -5.0}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, start: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Weights (first the constant) of a logistic regression drawn to `start` by a ridge; Newton steps, halved until they help."""
    x = np.column_stack([np.ones(len(x)), x])
    prior = np.zeros(x.shape[1]) if start is None else start

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * ((w - prior) ** 2).sum() / 2)

    w, now = prior.copy(), loss(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - prior))
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-8:
            step /= 2
        if now - after < 1e-9 * max(1.0, now):
            break
        w, now = w - step, after
    return w


def learn(candidates: DataFrame, sample: int, seed: int = 3) -> tuple[np.ndarray, tuple[float, float], dict[str, float]]:
    """Weights, calibration (slope, shift) and the log-odds that each state of the DOIs adds."""
    names = [f"f{i}" for i in range(_FEATURES)]
    known = {r.dois: r["count"] for r in candidates.groupBy("dois").count().collect()}
    rows = []
    for state in ("equal", "different"):
        # a threshold on a hash lets about as many rows through as are wanted, so no task gets more than its share
        drawn = F.pmod(F.xxhash64(F.lit(seed), "rid", "did"), F.lit(1 << 30))
        share = min(1.0, (sample + 5 * sample**0.5) / max(1, known.get(state, 0)))
        picked = candidates.where((F.col("dois") == state) & (drawn < int(share * (1 << 30)) + 1))
        rows.append(picked.orderBy(drawn, "rid", "did").limit(sample).select(*names).toPandas().to_numpy(dtype=float))
    if min(len(r) for r in rows) < 20:
        return _PRIOR, (1.0, 0.0), dict(_STATES)
    x, y = np.concatenate(rows), np.repeat([1.0, 0.0], [len(r) for r in rows])
    order = np.random.default_rng(seed).permutation(len(y))
    x, y = x[order], y[order]
    half = len(y) // 2
    weights = fit_logistic(x[:half], y[:half], start=_PRIOR)
    score = np.column_stack([np.ones(len(y) - half), x[half:]]) @ weights
    shift, slope = fit_logistic(score[:, None], y[half:], start=np.array([0.0, 1.0]))
    sure = candidates.withColumn("s", _score(weights)).withColumn("s", F.lit(float(slope)) * F.col("s") + F.lit(float(shift)))
    counts = {(r.dois, r.yes): r["count"] for r in sure.where("abs(s) > 3").groupBy("dois", (F.col("s") > 0).alias("yes")).count().collect()}
    told = ("equal", "near", "different")
    up, down = (sum(counts.get((s, k), 0) + 1 for s in told) for k in (True, False))
    odds = {s: float(np.clip(np.log((counts.get((s, True), 0) + 1) / up) - np.log((counts.get((s, False), 0) + 1) / down), -6, 6)) for s in told}
    return weights, (float(slope), float(shift)), odds | {"unknown": 0.0}


def _score(weights: np.ndarray) -> Column:
    total = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        total = total + F.lit(float(w)) * F.col(f"f{i}")
    return total


#: Pairs in one block from which its rows are dealt to _SALTS tasks.
_HEAVY = 10_000_000
#: Numbers that homes of documents have.
_HOMES = 1 << 16
#: A join by home and document takes rows as they lie if they were shuffled by home.
_AT_HOME = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def _written(frame: DataFrame, label: str, **settings: str) -> DataFrame:
    """`durable` under further settings, and what the write shuffled is removed from the executors' disks as soon as it is done."""
    spark = frame.sparkSession
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | settings
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return durable(frame, label)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _removed(table: DataFrame) -> None:
    """Removes the files of a written table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _housed(documents: DataFrame) -> DataFrame:
    """Document classes with their homes: numbers made of the first surname (`by_first`) and of the least one (`by_least`).

    A home that more than one in HOT_KEYS of the documents share is dealt to as many others as bring it down to that.
    """
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(_HOMES)).cast("int")
    least, first = _hashes(F.col("names"), 200), F.when(F.col("first").isNotNull(), F.xxhash64(F.lit(200), "first"))
    named = documents.withColumns({"by_first": place(F.coalesce(first, least, "cls")), "by_least": place(F.coalesce(least, first, "cls"))})
    floor = max(CROWD, documents.count() // HOT_KEYS)
    held = named.select(F.explode(F.array_distinct(F.array("by_first", "by_least"))).alias("home")).groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    many = F.broadcast(held.where(F.col("n") > floor).select("home", F.ceil(F.col("n") / floor).alias("deals")))
    for home in ("by_first", "by_least"):
        named = named.join(many.withColumnRenamed("home", home), home, "left")
        named = named.withColumn(home, F.when(F.col("deals").isNull(), F.col(home)).otherwise(place(F.col(home), F.pmod(F.xxhash64("cls"), F.col("deals"))))).drop("deals")
    return named


def _whole_blocks(left: DataFrame, right: DataFrame, common: list[str]) -> DataFrame:
    """Every pair (rid, did, home) of classes that shares a key of `_keys`, once for each such key; home: one of the document's."""
    lk, rk = _keys(left, common, True), _keys(_housed(right), common, False, "by_first", "by_least")
    home = F.when(_kind().isin(10, 20, 30), F.col("by_least")).otherwise(F.col("by_first"))
    rk = _written(rk.select("cls", "key", home.alias("home")), "document-keys")
    pairs = _written(_block_join(lk, rk), "candidates")
    _removed(rk)
    return pairs


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of `_whole_blocks`, each once, with both classes' attributes: (rid, did, r, d)."""
    r = left.select(F.col("cls").alias("rid"), F.struct(*_ATTRIBUTES).alias("r"))
    d = _housed(right).select(F.explode(F.array_distinct(F.array("by_first", "by_least"))).alias("home"), F.col("cls").alias("did"), F.struct(*_ATTRIBUTES).alias("d"))
    # all of a reference's pairs are in one task, so they are made distinct, listed and joined there
    once = pairs.repartition("rid").groupBy("rid", "did").agg(F.min("home").alias("home"))
    sent = _written(once.groupBy("rid", "home").agg(F.collect_list("did").alias("dids")).join(r, "rid"), "references-sent")
    _removed(pairs)
    # shuffled as they are; the lists are unfolded where the documents lie
    listed = sent.repartition("home").select("rid", "home", "r", F.explode("dids").alias("did"))
    scored = _written(_features(listed.join(d.repartition("home").hint("shuffle_hash"), ["home", "did"])), "match-features", **_AT_HOME)
    _removed(sent)
    return scored


def _block_join(lk: DataFrame, rk: DataFrame) -> DataFrame:
    """Pairs (rid, did, home) of (key, cls) and (key, cls, home) rows with the same key; the rows of blocks of _HEAVY pairs or more are dealt to _SALTS tasks."""
    lk, rk = lk.select(F.col("cls").alias("rid"), "key"), rk.withColumnRenamed("cls", "did")
    many = rk.groupBy("key").agg(F.count(F.lit(1)).alias("nd")).where(F.col("nd") > CROWD)
    many = _written(many, "large-blocks")
    if many.isEmpty():
        return lk.join(rk, "key").drop("key")
    counted = lk.join(many.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("nr"))
    heavy = _written(counted.join(many, "key").where(F.col("nr") * F.col("nd") >= _HEAVY).select("key", F.lit(_SALTS).alias("dealt")), "heavy-blocks")
    if heavy.isEmpty():
        return lk.join(rk, "key").drop("key")
    dealt = F.coalesce("dealt", F.lit(1))
    lk = lk.join(heavy, "key", "left").select("rid", "key", F.pmod(F.xxhash64("rid"), dealt).cast("int").alias("salt"))
    rk = rk.join(heavy, "key", "left").select("did", "home", "key", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("salt"))
    return lk.join(rk, ["key", "salt"]).drop("key", "salt")


def match(references: DataFrame, documents: DataFrame, *, sample: int = 20_000, least: float = 0.5, split: bool = False) -> DataFrame:
    """Matches of `reference_side` rows with `document_side` rows whose `confidence` is at least `least`.

    Every pair of classes that shares a key is compared; with `split`, which may lose some, crowded blocks are split.
    """
    ids = [c for c in references.columns if c not in _ATTRIBUTES]
    left_rows, left, left_total = _classes(references, "reference")
    right_rows, right, right_total = _classes(documents, "document")
    common = common_words(right)
    if split:
        r = left.select(F.col("cls").alias("rid"), F.struct(*_ATTRIBUTES).alias("r"))
        d = right.select(F.col("cls").alias("did"), F.struct(*_ATTRIBUTES).alias("d"))
        scored = _written(_features(_candidates(left, right, common).join(r, "rid").join(d, "did")), "match-features")
    else:
        scored = _met(_whole_blocks(left, right, common), left, right)
    weights, (slope, shift), odds = learn(scored, sample)
    told = F.create_map(*(F.lit(x) for pair in odds.items() for x in pair))
    logit = F.lit(slope) * _score(weights) + F.lit(shift) + told[F.col("dois")]
    kept = scored.select("rid", "did", (1 / (1 + F.exp(-logit))).alias("confidence")).where(F.col("confidence") >= least)
    kept = _written(kept, "class-matches")
    _removed(scored)
    matched = _spread(_spread(kept, left_rows, left, "rid", ids, left_total), right_rows, right, "did", ["doc"], right_total)
    return matched.select(*ids, "doc", "confidence")


def _spread(pairs: DataFrame, rows: DataFrame, classes: DataFrame, side: str, ids: list[str], total: int) -> DataFrame:
    """`pairs` of classes with the rows of one side's class; the rows of large classes are dealt to _SALTS tasks, their pairs to each."""
    floor = max(2, total // HOT_KEYS)
    large = F.broadcast(classes.where(F.col("copies") >= floor).select("sig"))
    told = pairs.join(classes.select(F.col("cls").alias(side), "sig", "copies"), side).drop(side)
    cold = told.where(F.col("copies") < floor).join(rows.join(large, "sig", "left_anti"), "sig")
    few = told.where(F.col("copies") >= floor).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    hot = rows.join(large, "sig", "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(_SALTS)).cast("int"))
    return cold.unionByName(few.join(hot, ["sig", "_salt"]).drop("_salt")).drop("sig", "copies")
