"""Decontamination: every place of an item is tried, and a find belongs to the text that holds it."""

import random
import re

from estate_spark.llm import decontamination


def words(rnd, count):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(count))


def plain(text):
    return b" " + b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())) + b" "


def edits_anywhere(window, text, most):
    """Fewest edits of the window in the text, by plain alignment; ``most`` + 1 for more."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
        if min(row) > most:
            return most + 1
    return min(row)


def test_excerpts_from_any_place(spark):
    """Excerpts of 120 to 180 bytes of longer items, found with as many windows and edits as plain alignment finds."""
    rnd = random.Random(11)
    size = decontamination.WINDOW
    items = [(i, words(rnd, n)) for i, n in enumerate((40, 45, 60))]
    docs = []
    for _, text in items:
        for length, at, changed in ((122, 31, 0), (124, 83, 0), (130, 17, 2), (140, 95, 0), (150, 101, 5), (180, 33, 12), (118, 31, 0), (100, 20, 0)):
            letters = list(text[at : at + length])
            for place in rnd.sample(range(len(letters)), changed):
                letters[place] = rnd.choice(["", "z", letters[place] + "z"])
            docs.append((len(docs), words(rnd, 4) + " q" + "".join(letters) + "q " + words(rnd, 4)))
    most, want = decontamination.edits_of(size), {}
    for item, text in items:
        body = plain(text)
        for doc, holder in docs:
            edits = [edits_anywhere(body[at : at + size], plain(holder), most) for at in range(len(body) - size + 1)]
            found = [e for e in edits if e <= most]
            if found:
                want[doc, item] = (len(found), min(found))
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.edits) for r in decontamination.find_leaks(df, benchmark).collect()}
    assert got == want and {doc % 8 for doc, _ in want} >= {0, 1, 2, 3, 4}


def test_finds_belong_to_the_text_that_holds_them(spark):
    """Documents of one slice that begin with a short item, and one whose halves stand in neighbouring documents."""
    rnd = random.Random(3)
    item = "which of these rivers flows north again"
    halves = words(rnd, 30)
    items = spark.createDataFrame([(1, item), (2, halves)], "item_id long, text string")
    assert len(plain(item)) == 41
    docs = []
    for i in range(64):
        docs += [(2 * i, words(rnd, 12) + " " + "k" * (i % 23)), (2 * i + 1, item + " " + words(rnd, 9))]
    middle = halves.index(" ", len(halves) // 2 - 4)
    docs += [(900, words(rnd, 5) + " " + halves[middle - 62 : middle]), (901, halves[middle + 1 : middle + 62] + " " + words(rnd, 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(df, items).collect())
    assert got == [(2 * i + 1, 1) for i in range(64)]
