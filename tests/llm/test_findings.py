"""The forest on kinds, formats and lines that it was not trained on, the letter
tables by brute force, and column names that clash."""

import base64
import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from ranklab.llm import findings, secret_scan

SF = "/root/testdata/sf0.001"
HELD = ["key_xox", "key_glpat", "named_uuid", "url_password", "etag", "md5", "camel", "author_low", "integrity", "data_uri"]


def tables(spark):
    base = secret_scan.keyed(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    words = secret_scan.ordinary_words(base)
    return words, *secret_scan.language_tables(base, words)


def test_kinds_and_lines_held_out(spark):
    known = tables(spark)
    found = secret_scan.planted_findings(*known, each=60)
    assert {r.kind for r in found.select("kind").distinct().collect()} == set(findings.kinds())
    model = secret_scan.train(found.where(~F.col("kind").isin(HELD)))
    rows = secret_scan.judged(secret_scan.planted_findings(*known, each=40, seed=2), model).select("kind", "label", "probability").collect()
    for held in (True, False):
        got = Counter((r.label == 1, r.probability >= 0.5) for r in rows if (r.kind in HELD) == held)
        assert got[True, True] / (got[True, True] + got[False, True]) >= 0.9, (held, got)
        assert got[True, True] / (got[True, True] + got[True, False]) >= 0.9, (held, got)
    assert findings.planted(known[0], only=[]).count() == 0


def lines():
    h = lambda kind, i, f=hashlib.sha1: f(f"{kind}/{i}".encode()).hexdigest()
    raw = lambda i: base64.b64encode(hashlib.sha512(f"raw{i}".encode()).digest()).decode().translate(str.maketrans("+/=", "aB7"))
    uuid = lambda i: "-".join([h("u", i)[:8], h("u", i)[8:12], h("u", i)[12:16], h("u", i)[16:20], h("u", i)[20:32]])
    names = ["anna", "peter", "maria", "george", "helen", "thomas", "laura", "martin", "julia", "simon"]
    words = ["river", "candle", "orange", "winter", "pencil", "garden", "silver", "window", "basket", "summer"]
    plain = {
        "commit": lambda i: f"see commit {h('c', i)} for this",
        "uuid": lambda i: f"the request {uuid(i)} was late",
        "sum": lambda i: f"file sha1={h('s', i)} was read",
        "etag": lambda i: f'and ETag: "{h("e", i, hashlib.md5)}" was sent',
        "name": lambda i: f'the author = "{names[i % 10]}{names[(i + 3) % 10]}{1900 + i}{i:02d}" wrote',
        "data": lambda i: f"src=data:image/png;base64,{(raw(i) + raw(i + 100)) * 3} is an image",
    }
    true = {
        "bare": lambda i: f"it is {raw(i)[:32]} here",
        "bearer": lambda i: f"Authorization: Bearer {raw(i)[40:80]} was sent",
        "live": lambda i: f"key sk_live_{raw(i)[3:27]} was used",
        "phrase": lambda i: f"set password={words[i % 10]}-{words[(i + 1) % 10]}-{words[(i * 7 + 3) % 10]}-{words[(i + 5) % 10]} there",
        "hex": lambda i: f'and token = "{h("t", i)}" was set',
    }
    return [(k, label, f(i)) for label, group in ((0, plain), (1, true)) for k, f in group.items() for i in range(20)]


def test_look_alikes_stay(spark):
    made = lines()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    data = [(1_000_000 + i, f"{' '.join(texts[i % len(texts)].split()[:12])} {t}", "x", "y", 1) for i, (_, _, t) in enumerate(made)]
    docs = spark.createDataFrame(data + [(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, found string, own_text string, key long")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.where("doc_id >= 1000000").collect()}
    assert all((r.found, r.own_text, r.key) == ("x", "y", 1) for r in got.values())
    right = Counter((k, label) for i, (k, label, t) in enumerate(made) if (got[1_000_000 + i].text != data[i][1]) == bool(label))
    assert all(right[k, label] >= 18 for k, label, _ in made), right


def test_letter_tables(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1200))
    texts = ["a bc def " * 3, f"{long} {long} defg defg defh", "", None, "DEFG x"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc long, key long, text string")
    moves, pieces = secret_scan.language_tables(docs)
    words = Counter(w for t in texts if t for w in "".join(c if "a" <= c <= "z" else " " for c in t.lower()).split() if len(w) > 1)
    grams = lambda w, n: [w[i:i + n] for i in range(len(w) - n + 1)]
    pairs, fours = Counter(), Counter()
    for w, n in words.items():
        for g in grams(w, 2):
            pairs[g] += n
        for g in grams(w, 4) if n > 1 else []:
            fours[g] += n
    first = Counter()
    for g, n in pairs.items():
        first[g[0]] += n
    assert {r.pair: round(r.logp, 9) for r in moves.collect()} == {g: round(math.log((n + 0.5) / (first[g[0]] + 14)), 9) for g, n in pairs.items()}
    assert {r.piece: round(r.logf, 9) for r in pieces.collect()} == {g: round(math.log(n / sum(fours.values())), 9) for g, n in fours.items()}


def test_extremes_of_long_values(spark):
    value = "ordinary" * 40 + "Q7z4X9k2" * 10 + "ordinary" * 60
    docs = spark.createDataFrame([(1, 1, f"plain words {value} and ordinary words ordinary")], "doc long, key long, text string")
    row = secret_scan.describe(secret_scan.candidates(docs), *secret_scan.language_tables(docs)).first()
    cut = [value[i:i + 256] for i in range(0, len(value) - 128, 128)]
    assert abs(row.digits - max(sum(c.isdigit() for c in p) / len(p) for p in cut)) < 1e-12
    assert abs(row.variety - max(len(set(p)) / len(p) for p in cut)) < 1e-12
