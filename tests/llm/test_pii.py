"""Surrogates against an independent detection, and texts made to break the search."""

import collections
import random

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import pii

DATA = "/root/testdata/sf0.001"
TITLES = regex.compile(r"(?:Mr|Herr|Monsieur|Señor|Sr|Sir|Господин|г-н|Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Madam|Госпожа|г-жа)\.? (\p{Lu}\p{Ll}+)( \p{Lu}\p{Ll}+)?(?!\p{L})")
RUN, LABEL = regex.compile(r"[\p{L}\p{N}._%+\-]+"), regex.compile(r"[\p{L}\p{N}\-]+")
ACCOUNT = regex.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])")
CARD = regex.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![A-Za-z0-9_-])")
PHONE = regex.compile(r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9_-])")


def word(c):
    return c.isascii() and (c.isalnum() or c == "_")


def alnum(c):
    return regex.match(r"[\p{L}\p{N}]", c) is not None


def email(text, i):
    m = RUN.match(text, i)
    if not m or m.end() == len(text) or text[m.end()] != "@" or not any(map(alnum, m[0])):
        return None
    first = LABEL.match(text, m.end() + 1)
    if not first or not any(map(alnum, first[0])):
        return None
    end = first.end()
    while end < len(text) and text[end] == "." and (more := LABEL.match(text, end + 1)):
        end = more.end()
    return end if end > first.end() else None


def address(text, i):
    parts, at = [], i
    for n in range(4):
        m = regex.compile(r"[0-9]{1,3}").match(text, at)
        found = None
        for size in (3, 2, 1):  # as a list of forms takes the longest that is a number up to 255
            piece = m[0][:size] if m and len(m[0]) >= size else None
            if piece and int(piece) < 256 and (size < 3 or piece[0] in "012") and (n == 3 or text[at + size : at + size + 1] == "."):
                found = piece
                break
        if found is None:
            return None
        parts.append(found)
        at += len(found) + (n < 3)
    follows = text[at : at + 2]
    return None if follows and (word(follows[0]) or follows[0] == "." and len(follows) > 1 and word(follows[1])) else at


def entities(text):
    """(start, end) of entities, found place by place."""
    out, i = [], 0
    while i < len(text):
        before, end = text[i - 1] if i else " ", None
        if not (alnum(before) or before in "._%+-"):
            end = email(text, i)
        if end is None and not word(before) and (m := ACCOUNT.match(text, i)):
            end = m.end()
        if end is None and not (word(before) or before == "."):
            end = address(text, i)
        if end is None and not (word(before) or before == "-") and (m := regex.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])").match(text, i)):
            end = m.end()
        if end is None and not (word(before) or before in ".+-") and (m := CARD.match(text, i)):
            end = m.end()
        if end is None and not (word(before) or before == ".") and (m := PHONE.match(text, i)):
            end = m.end()
        if end is None and not alnum(before) and (m := TITLES.match(text, i)):
            end = m.end()
        if end is None:
            i += 1
        else:
            out.append((i, end))
            i = end
    return out


def shape(s):
    return regex.sub(r"\p{Nd}", "0", regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", s)))


def check(docs, replaced, growing=False):
    """Every text keeps what lies between its entities, entities get one surrogate each, no two of them the same one."""
    given = {}
    for doc_id, text in docs:
        spans, new, at = entities(text or ""), replaced[doc_id][0], 0
        assert replaced[doc_id][1] == len(spans), text
        if not spans:
            assert new == text
            continue
        pieces = [text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)], strict=True)]
        m = regex.fullmatch("(.*?)".join(map(regex.escape, pieces)), new, regex.S)
        assert m, (text, new)
        for n, (a, b) in enumerate(spans, 1):
            old = text[a:b]
            if TITLES.fullmatch(old):
                assert m[n].split(" ")[0] == old.split(" ")[0] and m[n] != old
            elif "@" in old:
                assert m[n].lower() != old.lower() and m[n].rsplit(".", 1)[1] == old.rsplit(".", 1)[1].lower()
                key, value = old.lower(), m[n].lower()
                assert given.setdefault(key, value) == value
            else:
                assert m[n] != old and (growing or old.count(".") == 3 or shape(m[n]) == shape(old)), (old, m[n])
    assert len(set(given.values())) == len(given) and not set(given.values()) & set(given)


TEXTS = [
    "mail _@-.- now", "x@y.co, ٣٤@٥٦.٧٨ and a@b.c", "σοφία@παράδειγμα.ελ, иван@почта.рф, 李四@例子.公司", "1.2.3.4 1.2.3.4.5 256.1.1.1 1.2.3 999.9.9.9 10.20.30.40.", "DE89 3704 0044 0532 0130 00x DE89370400440532013000",
    "+1 2 3 +12345 +1 (22) 333-4444 555.666.7777 (555) 666-7777 555-66-7777 1234-56-7890", "4111-1111-1111-1111 4111111111111111 41111111111111111111111", "Mr Smith Mr. Smith Jones mr Smith MrSmith Frau Müller-Lüdenscheidt г-н Иванов Sir Ωnassis Mr Παππάς",
    "", "plain words only", "a\x01\x02\x01b x@y.org \x01\x02\x01 1.1.1.1", "\x01\x02\x01", "x@y.org", "x@y.orgx@y.org @x@y.org", "-a@-b.c- a..b@c..d a@b a@b. a@b.c.", "..@x.y .a@x.y",
]


def test_against_independent_detection(spark):
    rng = random.Random(4)
    alphabet = ["1", "2", "55", "4111", ".", "-", " ", "@", "a", "Z", "é", "+", "(", ")", "_", "Mr ", "Smith", "٣", "x@y.de", "\n", "DE89", pii.CUT]
    docs = [*enumerate([*TEXTS, *["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]])]
    for r in spark.createDataFrame(docs, "doc_id long, text string").select("text", pii.cut(F.col("text")).alias("parts")).collect():
        spans = entities(r["text"])
        assert r["parts"][1::2] == [r["text"][a:b] for a, b in spans] and "".join(r["parts"]) == r["text"]
    few = [*enumerate(TEXTS)]
    check(few, {r["doc_id"]: (r["text"], r["_pii_found"]) for r in pii.replace_pii(spark.createDataFrame(few, "doc_id long, text string")).collect()}, growing=True)


def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.op10_pii(spark, DATA).collect()}
    assert collections.Counter(n > 0 for _, n in got.values())[True] > 5
    check(docs, got)


@pytest.mark.parametrize("unit", ["x@a" + ".a" * 1_000_000, "1." * 2_000_000, "12 " * 1_000_000, "a@" * 2_000_000, "DE89 3704" * 400_000, "Mr Smith " * 20_000, "x" * 4_000_000 + "@y.de", "_@-." * 1_000_000, "+1 22 33 " * 300_000])
def test_very_long_texts(spark, unit):
    """Megabytes of one form end neither the JVM nor the time; the rest of the text stays."""
    docs = spark.createDataFrame([(1, f"start {unit} end"), (2, "x@y.de")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs).collect()}
    assert got[1].startswith("start ") and got[1].endswith(" end") and got[2] != "x@y.de"


def test_no_repeat_recurses():
    """Each group that repeats without a bound is possessive, or holds one character: Java runs those as loops."""
    assert not regex.search(r"\)[+*](?![+])|\)\{\d+,\}(?!\+)", pii.PATTERN + pii.HINT)
