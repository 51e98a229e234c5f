import re

from logweave.llm.decontaminate import UNITS, leaks, template, raw_words, without_leaks
from pyspark.sql import functions as F

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def plain_template(text, lead=""):
    raw = [w for w in SPLIT.split(lead + text.replace("#", "-")) if w]
    out = []
    for k, word in enumerate(raw):
        before = raw[k - 1][-1] if k else ""
        if word[0].isupper() and (before.isalnum() or before in (",", ";")) and before:
            out.append("#name")
        elif any(c in "0123456789" for c in word) and not any(c.isalpha() for c in word):
            out.append("#num")
        else:
            low = word.lower()
            bare = low.strip("".join({c for c in low if not c.isalnum()}))
            out.append("#unit" if out and out[-1] == "#num" and low.startswith(bare) and bare in UNITS else bare)
    return raw[len(lead.split()) :], out[len(lead.split()) :]


def plain_windows(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_bare(text):
    """Words in small letters without signs at their edges, by a rule that knows nothing of templates."""
    return [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in SPLIT.split(text or "") if w]


def holds(body, text):
    have, want = plain_bare(body), plain_bare(text)
    return any(have[k : k + len(want)] == want for k in range(len(have) - len(want) + 1))


def plain_leaks(docs, items):
    found = set()
    for item, text in items:
        if 0 < len(plain_bare(text)) < 5:
            found |= {(doc, item) for doc, body in docs if holds(body, text)}
            continue
        for lead in ("", "a "):
            want = set(plain_windows(plain_template(text or "", lead)[1]))
            for doc, body in docs:
                have = set(plain_windows(plain_template(body or "")[1]))
                if want and len(want & have) >= 0.8 * len(want):
                    found.add((doc, item))
    return found


ITEM = "A train leaves Berlin at 60 km per hour and after 3 hours it meets another train from Hamburg, how far did it go?"
ITEMS = [(1, ITEM), (2, "Was ist die Summe von 12 und 30 wenn man 12 zuerst nennt"), (3, None), (4, ""), (5, "two words"), (1, ITEM), (6, "What is 2?"),
         (7, "Nenne 7 Namen von Anna bis Anna"), (8, "...")]
DOCS = [
    (10, "Some prose first. " + ITEM + " And some prose after."),
    (11, "Quiz " + ITEM.replace("60", "75").replace("3 hours", "4 hours").replace("Berlin", "Paris").replace("Hamburg", "Rome") + " End"),
    (12, "A train leaves at noon and nothing of this is an item at all, 60 km away"),
    (13, None),
    (14, ""),
    (15, "two words"),
    (16, "two words more"),
    (17, "Was ist die Summe von 5 und 30 wenn man 5 zuerst nennt"),
    (18, "Was ist die Summe von 5 und 30 wenn man 9 zuerst nennt"),
    (10, "another row with the same id"),
    (None, "x " + ITEM),
    (19, "word " * 30_000 + ITEM),
    (20, "well then she asked (what is 2) plus 2 today, and two  \n WORDS."),
    (21, "what is 3? two other words"),
    # An inconsistent copy comes first, a verbatim one later.
    (22, "Nenne 9 Namen von Otto bis Emil. Dann: Nenne 7 Namen von Anna bis Anna"),
    (23, "Nenne 9 Namen von Otto bis Emil."),
]


def test_templates_equal_the_plain_ones(spark):
    texts = [t for _, t in DOCS + ITEMS if t] + ["(12.50) kg, 7% | 3 - 4", "ÄRGER Über Öl, Öl; Öl", "\t a\x0b#1 b# \r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", template(raw_words(F.col("text"))).alias("t")).collect():
        assert row.t.split(" ")[1:-1] == plain_template(row.text)[1], row.text


def test_leaks_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, ITEM_ID long").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, items).collect()}
    want = plain_leaks(DOCS, ITEMS)
    # 5 stands for 12 at its first slot and 9 at its second: the template alone matches, the slots do not.
    assert (18, 2) in want and (23, 7) in want
    assert set(got) == want - {(18, 2), (23, 7)}
    assert {i for i, k in got if k == 5} == {15, 16, 20} and {i for i, k in got if k == 6} == {20}
    assert got[22, 7].n_changed == 0
    assert got[10, 1].n_changed == 0 and got[11, 1].n_changed == 4 and got[17, 2].n_changed == 2
    kept = without_leaks(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 18, 21, 23] and kept.columns == docs.columns


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert without_leaks(docs, items.limit(0)).count() == len(DOCS)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "two words", 5, "a"), (2, None, 6, "b")], "doc_id long, text string, _Leaked int, window string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in without_leaks(docs, items).collect()] == [(2, None, 6, "b")]
