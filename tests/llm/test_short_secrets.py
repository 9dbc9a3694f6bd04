"""Assigned values of any length and symbols, and keys deep in long runs, reach the forest."""

import hashlib

from ranklab.llm import secret_scan


def test_short_and_deep_secrets(spark):
    h = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    prose = " ".join(f"the common {w} words of an ordinary text" for w in ("plain", "simple", "usual", "several"))
    deep = "ordinarytextofcommonwords" * 12 + "Q7z4" + h(1) + h(2) + "kX9"
    data = [(1, f"{prose} password=Tr0ub4dor!x9 {prose}"), (2, f"{prose} Server=db;User=sa;Password=My$ecr3t;Database=x1 {prose}"),
            (3, f"{prose} postgres://bob:s3cr%t9z@db.example.org/main {prose}"), (4, f"{prose} pwd = k3y#9 {prose}"),
            (5, f'{prose} {{"api_key":"z8-Q!4","user":"bob77"}} {prose}'), (6, f"{prose} {deep} {prose}"), (7, f"{prose} token: the usual {prose}")]
    data += [(100 + i, f"{prose} password={h(i)[:9]}!{h(i)[9:11]} {prose}") for i in range(30)]
    data += [(200 + i, f"{prose} wordsofanordinarytext{'abcdefghij'[i % 10] * 3} {prose}") for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {(r.doc, r.value): r.probability for r in secret_scan.scan(docs).collect()}
    want = {(1, "Tr0ub4dor!x9"), (2, "My$ecr3t"), (3, "s3cr%t9z"), (4, "k3y#9"), (5, "z8-Q!4"), (6, deep), (7, "the")}
    assert want <= set(found)
    text = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert text[1] == f"{prose} password=<secret> {prose}"
    assert text[2] == f"{prose} Server=db;User=sa;Password=<secret>;Database=x1 {prose}"
    assert text[7] == data[6][1] and text[200] == dict(data)[200]
    known = secret_scan.keyed(docs.where("doc_id in (6, 200)"), "doc_id", "text")
    row = {r.doc: r for r in secret_scan.describe(secret_scan.candidates(known), *secret_scan.language_tables(
        secret_scan.keyed(docs, "doc_id", "text"))).collect()}
    assert row[6].digits > 0.1 and row[6].transition < row[200].transition
