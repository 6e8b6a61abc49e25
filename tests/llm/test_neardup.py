import random
import re

import pyarrow as pa

from lexhaven.llm import neardup

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, width):
    words = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width):
    """Set sizes and smallest reachable ids by comparing all texts with each other."""
    sets = {i: shingles(t, width) for i, t in rows}
    best = {i: i for i in sets}

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 80 * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (small + large - both):
                    x, y = sorted((find(a), find(b)))
                    best[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **options).collect()}


def test_given_documents_against_brute_force(given):
    source = given("documents")
    rows = [(r.doc_id, r.text) for r in source.collect()]
    for width in (4, 5):
        assert found(source, width=width) == brute(rows, width)


def test_group_whose_members_are_not_all_alike(docs):
    """Chains, stars and a passage that many texts share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    rows = []
    for n in range(60):
        own = list(base)
        for at in rng.sample(range(120), 3):
            own[at] = word()
        rows.append((n, " ".join(own)))
    chain = [word() for _ in range(100)]
    for n in range(60, 80):
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append((n, " ".join(chain)))
    passage = [word() for _ in range(60)]
    rows += [(n, " ".join([word() for _ in range(60)] + passage)) for n in range(80, 110)]
    rows += [(n, rows[3][1].upper()) for n in (200, 201)]
    assert found(docs(rows), width=4) == brute(rows, 4)


def test_blocks_find_what_leaders_miss(docs, monkeypatch):
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 450)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(150)], []
    for n in range(40):
        base[rng.randrange(150)] = word()
        rows.append((n, " ".join(base)))
    assert found(docs(rows), width=4) == brute(rows, 4)


def test_edges(edges, docs):
    got = found(edges, width=4)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4)
    assert got[5][1] == got[6][1] == 5 and got[7][1] == 7
    repeated = neardup.near_duplicates(docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x")]), width=4)
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in repeated.collect()) == [
        (False, 1, 1), (False, 1, 1), (False, 2, 2), (True, None, None)]
    assert neardup.near_duplicates(docs([])).count() == 0


def test_rows_that_repeat_an_id_with_other_texts(docs):
    """Each text of an id keeps its links, and all of them hold for the id."""
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = lambda words: " ".join([*words[:-1], "other"])
    one, two, three = text(), text(), text()
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, near(one)), (8, near(two)), (9, " ".join(three)), (9, near(three)),
            (5, None), (2, " ".join(text())), (None, " ".join(one))]
    got = neardup.near_duplicates(docs(rows), width=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [
        (2, 97, 2), (3, 97, 3), (5, 0, 5), (5, 97, 3), (5, 97, 3), (8, 97, 3), (9, 97, 9), (9, 97, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_blocks_give_no_more_links_than_sets(spark):
    """All pairs of a block are alike, or nearly so; only what joins groups leaves it."""
    run = neardup._linking(80, 0)
    def block(words):
        rows = [(1, i, i, i < 20, [0], w) for i, w in enumerate(words)]
        names = ("token", "key", "component", "probe", "signature", "shingles")
        return pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})
    alike = run(block([list(range(100)) + [1000 + i] for i in range(40)]))
    assert alike.num_rows == 39
    assert run(block([list(range(70)) + list(range(1000 * i + 100, 1000 * i + 130)) for i in range(40)])).num_rows == 0
