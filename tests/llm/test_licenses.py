"""License labels against a plain alignment of words."""

import random

from tests.llm.conftest import sentence
from tests.llm.test_native import license_truth
from tidemark.llm import licenses


def aligned(text, notice):
    """The largest part of a notice's telling grams that stand in order within BAND words of one place; all for a short one."""
    words, own = licenses.template_words(text or ""), licenses.template_words(notice)
    exact = len(own) < licenses.SHORT
    if exact:
        return float(any(words[i : i + len(own)] == own for i in range(len(words))))
    grams = [(i, own[i : i + 2]) for i in range(len(own) - 1) if not licenses.COMMON.issuperset(own[i : i + 2])]
    said = {(p, tuple(words[p : p + 2])) for p in range(len(words) - 1)}
    where = {}
    for p, g in said:
        where.setdefault(g, []).append(p)
    starts = {p - i for i, g in grams for p in where.get(tuple(g), ())}
    return max((sum(any((i + start + k, tuple(g)) in said for k in range(-licenses.BAND, licenses.BAND + 1)) for i, g in grams) / len(grams) for start in starts), default=0.0)


def labels_by_force(text):
    """Of the phrases and notices."""
    notices = [(label, p) for label, p in licenses.PHRASES] + list(licenses.NOTICES)
    return ",".join(sorted({label for label, n in notices if aligned(text, n) >= licenses.COVERAGE}))


def test_labels(spark):
    rng, worn = random.Random(8), set()
    texts = ["Licensed under CC BY 4.0.", "under CC BY 4.0 4.0 4.0 4.0 4.0 4.0", "CC BY-SA 4.0 and CC BY-NC 4.0", "GNU General Public License", "GNU Lesser General Public License v2", "4.0 4.0 CC BY 4.0 CC BY 4.0"]
    for _, notice in licenses.NOTICES:
        around = [" ".join(sentence(rng, n)) for n in (20, 300)]
        for changes in (0, 1, 4, 30):
            words = notice.split()
            for _ in range(changes):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice([0, 1])] = sentence(rng, rng.choice([0, 1]))
            worn |= {len(texts)} if changes == 30 else set()
            texts.append(f"{around[0]} {' '.join(words)} {around[1]}")
    texts.append(" ".join(n for _, n in licenses.NOTICES))
    texts.append("public license general " * 3000 + "mit license")
    rows = licenses.scan_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == license_truth(text)
        by_force = labels_by_force(text)
        if r["doc_id"] in worn:  # of words that drift far, the span with the most votes isn't always the one with the most grams
            assert set(r["labels"].split(",")) <= {"", *by_force.split(",")}
        else:
            assert r["labels"] == by_force, (text[:300], r)
    found = {r["doc_id"]: r["labels"] for r in rows}
    assert found[0] == found[1] == "cc-by" and found[3] == "gpl" and found[4] == "lgpl" or found[4] == "gpl,lgpl"
