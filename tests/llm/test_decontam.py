import random

from lexhaven.llm import decontam

FILLER = "und dann kam noch etwas anderes hinzu das niemand vorher gesehen hatte".split()


def brute(text, item):
    """Fewest word edits between the item and any part of the text."""
    above = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        row = [i]
        for j, other in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (word != other)))
        above = row
    return min(above)


def test_planted_passages_up_to_the_limit(docs, given):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in given("benchmark").collect()]
    rows, want = [], set()
    for n, (item, text) in enumerate(items * 4):
        words = text.split()
        for _ in range(decontam.allowed(len(words)) if n % 3 else 0):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            if kind == 0:
                words[at] = f"neu{n}"
            elif kind == 1:
                words.insert(at, f"mehr{n}")
            else:
                del words[at]
        rows.append((n, " ".join(FILLER * 3 + words + FILLER)))
        want.add((n, item))
    rows += [(10_000 + n, " ".join(FILLER * 5)) for n in range(20)]
    got = decontam.contamination(docs(rows), given("benchmark")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & want) >= 0.98 * len(want)
    text_of, item_of = dict(rows), dict(items)
    for r in got:
        words = item_of[r.item_id].lower().split()
        assert r.edits == brute(text_of[r.doc_id].lower().split(), words) <= decontam.allowed(len(words))
        assert r.doc_id < 10_000


def test_given_documents_against_brute_force(given):
    documents, benchmark = given("documents").where("n_chars < 3000"), given("benchmark")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contamination(documents, benchmark).collect()}
    items = [(r.item_id, r.text.lower().split()) for r in benchmark.collect()]
    want = {}
    for row in documents.collect():
        words = row.text.lower().split()
        have = set(words)
        for item, own in items:
            # An item with more missing words than edits allowed cannot be there.
            if sum(w not in have for w in own) <= decontam.allowed(len(own)):
                if (d := brute(words, own)) <= decontam.allowed(len(own)):
                    want[row.doc_id, item] = d
    assert got == want and want


def test_edges(edges, docs, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same WORDS in both rows"), (4, "a"), (3, "same words in both rows")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.contamination(edges, items).collect()}
    assert got == {(5, 3, 0), (6, 3, 0), (4, 4, 0)}
    assert decontam.contamination(docs([]), items).count() == 0
    assert decontam.contamination(edges, items.limit(0)).count() == 0


def test_an_item_of_many_texts_goes_out_in_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 2000)
    sizes, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sizes.append(sum(len(x[1]) for x in value)) or send(self, value))
    texts = [" ".join(f"word{n}x{k}" for k in range(12)) for n in range(60)]
    items = spark.createDataFrame([(7, t) for t in texts] + [(8, texts[0])] * 3, "item_id long, text string")
    got = decontam.contamination(docs([(1, texts[0]), (2, texts[59])]), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (1, 8), (1, 8), (1, 8), (2, 7)]
    assert len(sizes) > 1 and max(sizes) < 2 * 2000
