"""Secret scan: candidate strings, then a random forest that removes false positives.

Candidates are runs of ``LEAST``-``MOST`` token characters in the white-space
separated words of the whole text, longer runs too, and whatever their length
and symbols the values behind key names (in the same word, or in the next words
as in ``password = x``; a value ends at a blank) and the passwords of URLs. A
value of more than ``MOST`` characters is cut into overlapping pieces of
``MOST`` characters, and every feature takes its extreme over all of them.
Each is described by its length, its characters (share of digits, capitals and
symbols, different characters, changes between character classes, mean log
probability of its letter transitions), its dictionary coverage (mean log
frequency of its 4-letter pieces in ordinary words), its path (part of a URL, a
path or an address) and its neighbours (key name before it, secret words and
words that name a digest, an identifier or encoded data around it).

The forest is trained from labelled findings. Where no reviewed findings are
given, these are planted ones (:mod:`ranklab.llm.findings`): their labels say
what was planted, and their features are computed like any finding's. Training
takes at most ``SAMPLE`` findings a label, chosen by hashes; the transitions and
the dictionary count the words of all texts, and everything else covers all
rows. Only DataFrame and Spark ML operations are used.

Defined cases: null and empty texts have no candidate; very long texts and words
are read whole; repeated rows and repeated secrets are each found; findings of
equal features get equal probabilities; with labelled findings of one label
only, that label is every candidate's; an empty table gives an empty result;
further columns of ``docs`` are not read and may have any names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklab.operators.skew import salted_join

from .common import stored
from .decontamination import keyed
from .findings import label_findings, planted

LEAST, MOST = 16, 256
SAMPLE = 4000
TREES, DEPTH, SEED = 40, 10, 7
#: Log relative frequency of a 4-letter piece that ordinary words have at most that seldom.
FLOOR = -16.0
THRESHOLD = 0.5
MARK = "<secret>"
#: Words that name a secret, words that name what only looks like one, and formats of issued keys.
SECRET_WORDS = r"(?i)(passw|pwd|secret|token|api_?key|apikey|credential|auth(?!or(?!i[sz]))|private|access_?key)"
DIGEST_WORDS = (r"(?i)(?<![a-z])(commit|revision|rev|merge|object|blob|sha-?[0-9]*|md5(sum)?|uuid|guid|etag|if-none-match|checksum|digest|"
                r"integrity|fingerprint|base64|request|session id|id)(?![a-z])")
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35})$"
#: Features of a value's pieces with the extreme that stands for the value, and features of the value in its place.
PIECES = {"digits": F.max, "capitals": F.max, "symbols": F.max, "variety": F.max, "changes": F.max, "transition": F.min, "coverage": F.min}
FEATURES = ["length", *PIECES, "hex", "in_path", "key_named", "near_named", "assigned", "digest_named"]
_BLANK = r"[\x20\x09-\x0D]+"
#: A key name with what may stand up to the sign that sets it, the sign, opening marks, and a value.
_KEY = SECRET_WORDS.replace("(passw", "(?:passw") + r"[A-Za-z0-9_.-]*[\"'\]]*"
_SET, _OPEN, _VALUE = "(?:=>|:=|==?|:)", r"[\[({<]*", r"([^\"'][^\"]*)"
_URL_KEY = r"://[^\s/:@]*:"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc, key, position, word, value, before, after) of ``docs`` (doc, key, text)."""
    words = docs.select("doc", "key", F.split("text", _BLANK).alias("w"))
    run = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
    hits = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("position"), w.alias("word"))),
                    lambda x: (F.octet_length(x["word"]) >= LEAST) & F.rlike(x["word"], F.lit(run)))
    found = words.select("doc", "key", "w", hits.alias("hits")).where(F.size("hits") > 0).select("doc", "key", "w", F.explode("hits").alias("h"))
    near = found.select(
        "doc", "key", F.col("h.position").alias("position"), F.col("h.word").alias("word"),
        F.concat_ws(" ", F.slice("w", F.greatest(F.col("h.position") - 1, F.lit(1)), F.least(F.col("h.position"), F.lit(2)))).alias("before"),
        F.concat_ws(" ", F.slice("w", F.col("h.position") + 2, F.lit(1))).alias("after"))
    long = near.select("*", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(run), F.lit(0)))).alias("value"))
    return long.unionByName(assigned_values(docs)).distinct()


def assigned_values(docs: DataFrame) -> DataFrame:
    """The columns of :func:`candidates` for values behind key names and in URL credentials."""
    some = docs.where(F.col("text").rlike(_KEY) | F.col("text").rlike(_URL_KEY + r"[^\s/]+@")).select("doc", "key", F.split("text", _BLANK).alias("w"))
    placed = F.transform("w", lambda w, i: F.struct(
        i.alias("position"), w.alias("word"),
        F.concat_ws(" ", F.slice("w", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))).alias("before"),
        F.concat_ws(" ", F.slice("w", i + 2, F.lit(1))).alias("after")))
    set_before, key_before, set_first = _KEY + " ?" + _SET + r"[\"']?$", _KEY + "$", "^" + _SET + "."

    def behind(x):
        return x["before"].rlike(set_before) | (x["before"].rlike(key_before) & x["word"].rlike(set_first))

    hits = F.filter(placed, lambda x: x["word"].rlike(_KEY + _SET) | x["word"].rlike(_URL_KEY) | behind(x))
    near = some.select("doc", "key", F.explode(hits).alias("h")).select("doc", "key", "h.*")
    # settings that follow each other in one word (connection strings, queries) are looked at one by one
    settings = F.split("word", r"(?=[;&,?|][A-Za-z_][A-Za-z0-9_.-]*=)")
    inside = F.flatten(F.transform(settings, lambda x: F.array(
        F.regexp_extract(x, _KEY + _SET + _OPEN + _VALUE, 1), F.regexp_extract(x, _KEY + _SET + _OPEN + "\"([^\"]+)", 1),
        F.regexp_extract(x, _KEY + _SET + _OPEN + "'([^']+)", 1))))
    word = F.struct(F.col("before"), F.col("word"))
    next_ = F.when(behind(word), F.regexp_extract("word", f"^{_SET}?{_OPEN}[\"']?{_VALUE}", 1)).otherwise("")
    url = F.regexp_extract_all("word", F.lit(_URL_KEY + r"([^\s/]+)@"), F.lit(1))
    values = F.transform(F.concat(inside, F.array(next_), url), lambda v: F.regexp_replace(v, r"[\"'`;,.:)\]}>]+$", ""))
    return near.select("*", F.explode(F.array_distinct(F.filter(values, lambda v: v.rlike("[A-Za-z0-9]")))).alias("value"))


def _characters() -> dict[str, Column]:
    """Features that a piece has by itself."""
    n = F.length("part").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count("part", F.lit(pattern)) / n

    return {
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "variety": F.size(F.array_distinct(F.split("part", ""))) / n,
        "changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
    }


def _placed() -> dict[str, Column]:
    """Features of a value in its place."""
    v, prefix = F.col("value"), F.split_part(F.col("word"), F.col("value"), F.lit(1))
    return {
        "length": F.log(F.length(v).cast("double")),
        "hex": (v.rlike("^([0-9a-f]+-?)+$") | v.rlike("^([0-9A-F]+-?)+$")).cast("double"),
        "in_path": (F.col("word").rlike(r"://|@|\\") | (F.regexp_count("word", F.lit("/")) >= 2)).cast("double"),
        "key_named": (prefix.rlike(SECRET_WORDS) | prefix.rlike(_URL_KEY + "$")).cast("double"),
        "near_named": (F.col("before").rlike(SECRET_WORDS) | F.col("after").rlike(SECRET_WORDS)).cast("double"),
        "assigned": (prefix.rlike("[=:]") | F.col("before").rlike("[=:]$")).cast("double"),
        "digest_named": (F.col("before").rlike(DIGEST_WORDS) | prefix.rlike(DIGEST_WORDS)
                         | ((F.length("value") < F.length("word")) & F.col("word").rlike(r"(?i)/(commit|blob|tree|objects?)/"))).cast("double"),
    }


def _pieces(column: str | Column, n: int) -> Column:
    """The ``n``-character pieces of a string."""
    text = F.col(column) if isinstance(column, str) else column
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def _cuts(column: str, overlap: int) -> Column:
    """Parts of ``MOST`` characters of a string, each of which begins with the last ``overlap`` characters of the part before."""
    step = MOST - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(column) - MOST) / step), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.substring(F.col(column), i * step + 1, F.lit(MOST)))


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words (letters only, two at least) of all texts, stored."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("length(word) > 1")
    return stored(words.groupBy("word").agg(F.count("*").alias("n")))


def language_tables(docs: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Letter transitions (pair, logp) and dictionary pieces (piece, logf: log
    relative frequency among the pieces of words seen twice or more) of the
    ordinary words of all texts."""
    words = ordinary_words(docs) if words is None else words
    # neighbouring parts share one letter less than a pair or a piece has, so that each is counted once
    pairs = (words.select("n", F.explode(_cuts("word", 1)).alias("part")).select("n", F.explode(_pieces("part", 2)).alias("pair"))
             .groupBy("pair").agg(F.sum("n").alias("n")))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("m"))
    moves = pairs.join(first, F.substring("pair", 1, 1) == F.col("first")).select("pair", F.log((F.col("n") + 0.5) / (F.col("m") + 14)).alias("logp"))
    pieces = stored(words.where("n > 1 and length(word) > 3").select("n", F.explode(_cuts("word", 3)).alias("part"))
                    .select("n", F.explode(_pieces("part", 4)).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n")))
    total = pieces.agg(F.sum("n")).first()[0] or 1
    return stored(moves), pieces.select("piece", F.greatest(F.log(F.col("n") / float(total)), F.lit(FLOOR)).alias("logf"))


def describe(found: DataFrame, moves: DataFrame, pieces: DataFrame) -> DataFrame:
    """``found`` with the features. Letter tables are joined to the distinct pieces of the values."""
    parts = found.select("value").distinct().select(F.sha2("value", 256).alias("_of"), F.explode(F.array_distinct(_cuts("value", MOST // 2))).alias("part"))
    parts = stored(parts)
    values = parts.select("part").distinct().withColumn("low", F.lower("part"))
    # 26 * 26 pairs and at most 26 ** 4 pieces of four letters
    by_pair = (values.select("part", F.explode(_pieces("low", 2)).alias("pair")).join(F.broadcast(moves), "pair", "left")
               .groupBy("part").agg(F.avg(F.coalesce("logp", F.lit(-9.0))).alias("transition")))
    by_piece = (values.select("part", F.explode(_pieces("low", 4)).alias("piece")).join(F.broadcast(pieces), "piece", "left")
                .groupBy("part").agg(F.avg(F.coalesce("logf", F.lit(FLOOR))).alias("coverage")))
    extremes = (parts.join(by_pair.join(by_piece, "part"), "part").withColumns(_characters())
                .groupBy("_of").agg(*[extreme(name).alias(name) for name, extreme in PIECES.items()]))
    # one value may stand in any number of documents
    return salted_join(found.withColumn("of", F.sha2("value", 256)), extremes, [("of", "_of")], "inner").withColumns(_placed()).drop("of")


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A forest of at most about ``sample`` findings a label, or the one label
    that there is (a float), or None without findings."""
    known = labelled.where("label is not null")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), None)
    lot = F.pmod(F.xxhash64("value", "doc", "key", "position"), F.lit(1 << 30)) / float(1 << 30)
    within = F.when(F.col("label") == 1, lot < sample / counts[1.0]).otherwise(lot < sample / counts[0.0])
    rows = stored(known.where(within).select("label", *FEATURES).orderBy(*FEATURES))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def planted_findings(words: DataFrame, moves: DataFrame, pieces: DataFrame, **lines) -> DataFrame:
    """Labelled findings (the columns of :func:`describe`, ``kind``, ``label``) of planted lines among ``words``."""
    made = stored(planted(words, **lines))
    return stored(label_findings(describe(stored(candidates(made)), moves, pieces), made))


def judged(described: DataFrame, model) -> DataFrame:
    """``described`` with ``probability`` by what :func:`train` gave."""
    if model is None or isinstance(model, float):
        return described.withColumn("probability", F.lit(float(model or 0.0)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
    return model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc, key, position, value, issued, probability, is_secret) of all
    candidates. ``labelled`` (the columns of :func:`describe` and ``label``) are
    reviewed findings; without them planted ones are used."""
    base = keyed(docs, id_col, text_col)
    found = stored(candidates(base))
    words = ordinary_words(base)
    moves, pieces = language_tables(base, words)
    model = train(planted_findings(words, moves, pieces) if labelled is None else labelled)
    return judged(stored(describe(found, moves, pieces)), model).select(
        "doc", "key", "position", "value", F.col("value").rlike(ISSUED).alias("issued"), "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every occurrence of a secret in its text replaced by ``mark``
    (of one under ``LEAST`` characters: where it stands by itself, not inside a longer word)."""
    secrets = (scan(docs, id_col, text_col, labelled).where("is_secret").groupBy("doc", "key")
               .agg(F.array_sort(F.collect_set("value"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
                                 .when(a < b, -1).when(a > b, 1).otherwise(0)).alias("found")))
    doc, text, found = F.col(id_col).cast("long"), F.col(text_col), F.col("found")
    # the caller's columns travel as one struct, so their names meet no name of this function
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("own_text"), F.coalesce(doc, F.lit(0)).alias("doc"),
                      F.xxhash64(doc.isNull(), F.coalesce(text, F.lit(""))).alias("key"))
    both = own.join(secrets, ["doc", "key"], "left")
    clean = F.when(found.isNull(), F.col("own_text")).otherwise(
        F.aggregate(found, F.col("own_text"), lambda text, value: F.when(F.length(value) >= LEAST, F.replace(text, value, F.lit(mark)))
                    .otherwise(F.regexp_replace(text, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])")),
                                               F.lit(mark.replace("\\", r"\\").replace("$", r"\$"))))))
    return both.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
