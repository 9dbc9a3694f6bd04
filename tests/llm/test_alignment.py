"""Alignment of two tokenizers against a pass over all ends, in memory."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ranklab.llm import alignment, catalog
from ranklab.llm.common import documents


def decoder():
    """The bytes of a byte-level entry, by the tokenizers library's own decoder."""
    from tokenizers.pre_tokenizers import ByteLevel
    shown = {}
    for b in range(256):
        for tail in (b"", b"\x80", b"\x80\x80", b"\x80\x80\x80"):
            text = (bytes([b]) + tail).decode(errors="ignore")
            if text and text.encode()[0] == b:
                shown[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0][0]] = b
                break
    return shown


def expected(rows):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment.byte_level_alphabet()
    assert all(alphabet[c] == b for c, b in decoder().items())

    def spell_b(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    parts, count = [], Counter()
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        a = coder.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        spelled_a, spelled_b = [bytes(alphabet[c] for c in coder.id_to_token(i)) for i in a], [spell_b(i) for i in b]
        if not text or b"".join(spelled_a) != want or b"".join(spelled_b) != want:
            parts.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
        last_b = {e: i for e, i in zip(ends_b, b)}
        links = [(i, last_b[e]) for e, i in zip(ends_a, a) if e in last_b]
        cuts, groups, low = [e for e in ends_a if e in last_b], [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for e, i in zip(ends_a, a) if low < e <= cut) + "|" +
                          ",".join(str(i) for e, i in zip(ends_b, b) if low < e <= cut)) if len(cuts) < 2000 else None
            low = cut
        if len(cuts) >= 2000:  # long texts: one pass
            of = {c: k for k, c in enumerate(cuts)}
            group_a, group_b = defaultdict(list), defaultdict(list)
            for ends, ids, into in ((ends_a, a, group_a), (ends_b, b, group_b)):
                k = 0
                for e, i in zip(ends, ids):
                    into[k].append(str(i))
                    k += e in of
            groups = [",".join(group_a[k]) + "|" + ",".join(group_b[k]) for k in range(len(cuts))]
        count.update(links)
        parts.append((doc, a, b, links, groups))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return Counter((doc, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, a, b, links, groups in parts)


def got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r) for r in df.collect())


def test_cuts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000):
        for share in (0.0, 0.05, 0.5, 1.0):
            a = np.cumsum(rng.integers(1, 4, n))
            b = np.unique(np.concatenate([a[rng.random(n) < share], rng.integers(1, a[-1] + 1, n // 2), a[-1:]]))
            assert alignment.common_cuts(a, b).tolist() == np.flatnonzero(np.isin(a, b)).tolist()
    assert len(alignment.common_cuts(np.zeros(0, int), np.zeros(0, int))) == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert got(catalog.op13_shared_cuts(spark, sf)) == expected([(r.doc_id, r.text) for r in documents(spark, sf).collect()])


def test_odd_rows_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE_BYTES", 200)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 400)
    data = [(None, None), (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n\t end "), (5, "a▁b is not its bytes"), (6, "<|endoftext|> and <0x41> <s>"),
            (7, "İ क़ 日本語 \U0001f600 \x00  "), (8, "same row"), (8, "same row"), (None, "no id"), (9, "word, " * 5000), (10, "x" * 3000), (11, "⁇ <unk>")]
    data += [(100 + i, f"the {i} cats' dogs don't {'ab' * (i % 7)}") for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "links", "pair", "n_a")})
    out = got(alignment.align(docs.repartition(3), catalog.BYTE_LEVEL, catalog.PIECES))
    assert out == expected(data)
    assert (None, 0, 0, 0, 0, 0, 0, "") in out and (5, 0, 0, 0, 0, 0, 0, "") in out


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, catalog.BYTE_LEVEL, catalog.PIECES).count() == 0


def test_ids_of_every_character():
    """A's ids are the tokenizers library's, and spell every character."""
    a, plain = alignment.ByteLevel(catalog.BYTE_LEVEL), Tokenizer.from_file(catalog.BYTE_LEVEL)
    plain.encode_special_tokens = True
    assert a.ranks
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s{chr(c)}" for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts += ["<|endoftext|> a", "  \n\n x\t ", "DON'T don't we'LL we'll 're"]
    for t, ids, x in zip(texts, a.encode(texts), plain.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)):
        assert ids.tolist() == x.ids, ascii(t)
        assert b"".join(a.bytes[i] for i in ids) == (" " + t).encode()
