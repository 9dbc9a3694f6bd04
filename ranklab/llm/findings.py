"""Labelled findings: lines with a planted secret or a planted look-alike.

No table holds reviewed findings, so lines are made whose label is known because
of what was planted in them, not because of how it looks to the forest: issued
keys, bearer tokens, signed web tokens, assigned random values, passphrases and
URL passwords on one side; commit hashes, checksums, entity tags, UUIDs, encoded
data, identifiers, names with digits, paths, numbers and placeholders on the
other. The words around them are words of the corpus. ``each`` lines a kind
bound the training data; reviewed findings can stand in their place
(``secret_scan.scan(labelled=...)``).

Values come from SHA-512 of (seed, kind, number), so a run repeats itself and
another seed gives other lines of the same kinds. DataFrame functions only.

Defined cases: without corpus words the words are :data:`FILLER`; an empty list
of kinds gives no lines.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import stored

EACH = 150
WORDS = 2000
#: Words for lines when the corpus has none, and parts of made names.
FILLER = ["the", "and", "with", "value", "under", "other", "number", "before", "system", "report", "window", "letter"]


def _digest(salt: str) -> Column:
    return F.sha2(F.concat_ws(":", "seed", "kind", F.lit(salt), "i"), 512)


def _hex(n: int, salt: str = "v") -> Column:
    return F.substring(_digest(salt), 1, n)


def _base64(salt: str) -> Column:
    """84 characters of base64, without line breaks."""
    return F.substring(F.regexp_replace(F.base64(F.unhex(_digest(salt))), r"[\r\n]", ""), 1, 84)


def _mixed(n: int | Column, salt: str = "v") -> Column:
    """Letters of both cases and digits."""
    both = F.concat(*[F.translate(_base64(f"{salt}{k}"), "+/", "kW") for k in range(2)])
    return F.substring(both, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def _capital(n: int, salt: str = "v") -> Column:
    return F.substring(F.upper(_mixed(120, salt)), 1, n)


def _number(n: int, salt: str = "v") -> Column:
    return F.substring(F.regexp_replace(_digest(salt), "[a-f]", ""), 1, n)


def _encoded(n: int, salt: str = "v") -> Column:
    """Base64 with its symbols; ``n`` of any size up to 1,024."""
    return F.substring(F.concat(*[_base64(f"{salt}{k}") for k in range(-(-n // 84))]), 1, n)


def _uuid() -> Column:
    h = _digest("v")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _word(k: int) -> Column:
    """The ``k``-th word that the line drew."""
    return F.element_at("w", F.lit(k))


def _pick(*choices: str, salt: str = "pick") -> Column:
    at = F.pmod(F.xxhash64("seed", "kind", F.lit(salt), "i"), F.lit(len(choices))).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, choices)), at)


def _length(low: int, high: int) -> Column:
    return (F.pmod(F.xxhash64("seed", "kind", F.lit("length"), "i"), F.lit(high - low + 1)) + low).cast("int")


def _name(k: int) -> Column:
    return F.initcap(_word(k))


def kinds() -> dict[str, tuple[int, Column, Column, Column]]:
    """kind -> (label, what stands before the value, the value, what stands after it)."""
    none, quote = F.lit(""), F.lit('"')
    key = _pick("password", "api_key", "client_secret", "token", "auth_token", "SECRET_KEY", "access_key", "db_password", "apikey", "credential")
    sign = _pick("=", ' = "', '":"', ": ", " := ", " => '", salt="sign")
    shut = F.when(sign.contains('"'), '"').when(sign.contains("'"), "'").otherwise("")
    named = F.concat(key, sign)
    phrase = F.concat_ws("-", _word(5), _word(6), _word(7), _word(8))
    jwt = F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), _mixed(60), F.lit("."), _mixed(43, "s"))
    secret = {
        "key_akia": (none, F.concat(F.lit("AKIA"), _capital(16)), none),
        "key_ghp": (_pick("", "use ", "pushed with "), F.concat(_pick("ghp_", "gho_", "ghs_", salt="p"), _mixed(36)), none),
        "key_live": (none, F.concat(_pick("sk_live_", "rk_live_", "sk_test_", salt="p"), _mixed(24)), none),
        "key_sk": (none, F.concat(F.lit("sk-"), _mixed(48)), none),
        "key_xox": (none, F.concat(F.lit("xoxb-"), _number(12), F.lit("-"), _mixed(24)), none),
        "key_aiza": (_pick("", "key=", "?key="), F.concat(F.lit("AIza"), _mixed(35)), none),
        "key_glpat": (none, F.concat(F.lit("glpat-"), _mixed(20)), none),
        "bare_random": (none, _mixed(_length(20, 64)), none),
        "bearer": (_pick("Authorization: Bearer ", "bearer ", "Bearer "), _mixed(_length(24, 60)), none),
        "signed_token": (_pick("", "Authorization: Bearer ", "jwt "), jwt, none),
        "named_random": (named, _mixed(_length(16, 48)), shut),
        "named_encoded": (named, _encoded(40), shut),
        "named_hex_short": (named, F.substring(_digest("v"), F.lit(1), _length(16, 30)), shut),
        "named_hex": (named, F.substring(_digest("v"), F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), _length(1, 3))), shut),
        "named_uuid": (named, _uuid(), shut),
        "named_short": (F.concat(key, _pick("=", '="', ":", salt="sign")), F.concat(_name(5), _pick("!", "#", "$", "%", "-", salt="s"), _number(3)), none),
        "named_pass": (F.concat(_pick("password", "passwd", "pwd", "db_password"), _pick("=", '="', ": ", " = ", salt="sign")), F.concat(_mixed(5), _pick("!", "#", "$", "", salt="s"), _mixed(4, "t")), none),
        "phrase": (_pick("password=", "passwd=", "db_password=", "password: ", 'password = "'), phrase, none),
        "phrase_joined": (_pick("password=", "passwd=", "secret=", "pwd: "), F.concat(_word(5), _word(6), _word(7), _word(8)), none),
        "url_password": (F.concat(_pick("postgres", "mysql", "https", "amqp"), F.lit("://"), _word(5), F.lit(":")), _mixed(_length(8, 20)), F.lit("@db.example.org/main")),
    }
    similar = {
        "commit": (_pick("commit ", "merge commit ", "fixed in commit ", "revision ", "rev=", "cherry picked from commit ", "commit="), _hex(40), none),
        "bare_hex": (_pick("", "see ", "object "), F.substring(_digest("v"), F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), _length(1, 3))), none),
        "uuid": (_pick("", "id ", "uuid=", "request ", 'guid: "', "session id ", "urn:uuid:"), _uuid(), none),
        "sha1": (_pick("sha1=", "sha1:", "SHA1: ", "sha-1 ", "checksum "), _hex(40), none),
        "sha256": (_pick("sha256=", "sha256:", "digest: sha256:", "SHA256 ", "@sha256:"), _hex(64), none),
        "md5": (_pick("md5=", "md5sum ", "MD5: ", "Content-MD5: "), _hex(32), none),
        "etag": (_pick('ETag: "', 'etag="', 'If-None-Match: "', 'ETag: W/"'), F.substring(_digest("v"), F.lit(1), F.element_at(F.array(F.lit(16), F.lit(32), F.lit(40)), _length(1, 3))), quote),
        "integrity": (_pick("integrity sha512-", 'integrity="sha384-', "integrity: sha512-"), _encoded(86), F.lit("==")),
        "data_uri": (_pick("data:image/png;base64,", "src=data:image/gif;base64,", "data:font/woff2;base64,"), F.concat(F.lit("iVBORw0KGgo"), _encoded(400)), none),
        "encoded_body": (_pick("Content-Transfer-Encoding: base64 ", "base64 ", "base64: "), _encoded(76), none),
        "fingerprint": (_pick("fingerprint SHA256:", "key fingerprint is SHA256:", "SHA256:"), _encoded(43), none),
        "author": (_pick('author = "', "author: ", "authors=", "Author=", "by ", "user "), F.concat(_name(5), _name(6), _number(4)), none),
        "author_low": (_pick('author = "', "author: ", "authored by ", "login "), F.concat(_word(5), _pick("", "_", "-", salt="s"), _word(6), _number(8)), none),
        "identifier": (_pick("call ", "def ", "class ", "", "secret ", "tokens "), F.concat_ws("_", _word(5), _word(6), _word(7)), none),
        "camel": (_pick("new ", "class ", "", "token ", "private "), F.concat(_name(5), _name(6), _name(7)), none),
        "constant": (_pick("", "define "), F.upper(F.concat_ws("_", _word(5), _word(6), _word(7))), none),
        "shout": (none, F.upper(F.concat(_word(5), _word(6), _word(7))), F.lit("!!")),
        "long_word": (none, F.concat(_word(5), _word(6), _word(7)), none),
        "hyphens": (none, F.concat_ws("-", _word(5), _word(6), _word(7), _word(8)), none),
        "path": (none, F.concat_ws("/", F.lit(""), _word(5), _word(6), F.concat(_word(7), _number(2)), _word(8)), F.lit(".txt")),
        "address": (F.concat(F.lit("https://example.org/"), _number(4), F.lit("/")), F.concat_ws("-", _word(5), _word(6), _word(7), _number(3)), none),
        "commit_url": (F.concat(F.lit("https://example.org/"), _word(5), F.lit("/commit/")), _hex(40), none),
        "mail": (none, F.concat(_word(5), _word(6), _number(6)), F.lit("@example.org")),
        "number": (_pick("", "card ", "id=", "order ", "serial: "), _number(16), none),
        "stamp": (_pick("", "at ", "build ", "version "), F.concat(F.lit("20"), _number(2), F.lit("-0"), _number(1, "m"), F.lit("-1"), _number(1, "d"), F.lit("T1"), _number(1, "h"), F.lit("-22-33")), none),
        "placeholder": (F.concat(_pick("password", "token", "api_key", "secret"), _pick("=", ": ", " = ", salt="sign")), _pick("required", "true", "none", "null", "example", "optional", "changed", "your", salt="v"), none),
        "prose": (_pick("password: ", "secret: ", "token: ", "the token = ", "private: "), _word(5), none),
        "count": (_pick("max_tokens=", "token_count: ", "tokens: ", "total_tokens = "), _number(4), none),
        "template": (_pick("password=", 'api_key = "', "token: "), F.concat(_pick("${", "$", "%", "{{", salt="o"), F.upper(F.concat_ws("_", _word(5), _word(6))), _pick("}", "}}", salt="c")), none),
    }
    return {k: (1, *v) for k, v in secret.items()} | {k: (0, *v) for k, v in similar.items()}


def planted(words: DataFrame, each: int = EACH, seed: int = 1, only: Iterable[str] | None = None) -> DataFrame:
    """(doc, key, text, kind, planted, label): ``each`` lines of every kind (or
    of ``only`` these). ``words`` (word, n) are the words of the corpus, of which
    ``WORDS`` are drawn by hash, of 3 to 12 letters."""
    spark, made = words.sparkSession, kinds()
    made = {k: v for k, v in made.items() if only is None or k in set(only)}
    if not made:
        return spark.createDataFrame([], "doc long, key long, text string, kind string, planted string, label double")
    filler = spark.createDataFrame([(w,) for w in FILLER], "word string")
    some = (words.where("length(word) between 3 and 12 and n > 1").select("word").orderBy(F.xxhash64("word"), "word").limit(WORDS)
            .unionByName(filler).distinct())
    # at most WORDS + len(FILLER) short words: one row
    bag = some.agg(F.sort_array(F.collect_list("word")).alias("bag"))
    bag = F.broadcast(bag.withColumn("one", F.lit(1)))
    # the words of all lines are drawn by one join and stored: the kinds then only read them
    names = F.array(*[F.lit(k) for k in made])
    numbered = spark.range(0, each * len(made), 1, 1).select(
        (F.col("id") % each).alias("i"), F.element_at(names, (F.floor(F.col("id") / each) + 1).cast("int")).alias("kind"),
        F.lit(seed).alias("seed"), F.lit(1).alias("one"))
    drawn = stored(numbered.join(bag, "one").select("i", "kind", "seed", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.element_at(
        "bag", (F.pmod(F.xxhash64("seed", "kind", "i", k), F.size("bag")) + 1).cast("int"))).alias("w")))
    lines = []
    for at, (kind, (label, head, value, foot)) in enumerate(made.items()):
        lead, tail = F.concat_ws(" ", F.slice("w", 1, 4)), F.concat_ws(" ", F.slice("w", 9, 4))
        lines.append(drawn.where(F.col("kind") == kind).select((-1 - at * F.lit(each).cast("long") - F.col("i")).alias("doc"), F.lit(0).cast("long").alias("key"), F.concat(
            lead, F.lit(" "), head, value, foot, F.lit(" "), tail).alias("text"), "kind", value.alias("planted"), F.lit(float(label)).alias("label")))
    return reduce(DataFrame.unionByName, lines)


def label_findings(described: DataFrame, lines: DataFrame) -> DataFrame:
    """``described`` findings of ``lines`` (a bounded table) with the line's
    ``kind`` and ``label``: those that are the planted value, a part of it, or
    hold it. Other findings of a line are left out."""
    about = F.broadcast(lines.select(F.col("doc").alias("line"), "kind", "planted", "label"))
    inside = F.contains("planted", "value") | F.contains("value", "planted")
    return described.join(about, F.col("doc") == F.col("line")).where(inside).drop("line", "planted")
