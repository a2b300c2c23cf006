import re

from cloakframe.llm.ngram_join import jaccard_components


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df, **bounds):
    return {r[0]: (r[1], r[2]) for r in jaccard_components(df, **bounds).collect()}


def test_brute_force(make_docs, corpus):
    assert got(make_docs(corpus)) == brute(corpus)


def test_large_group_of_near_copies(make_docs):
    """Lists longer than are compared at once, in parts, and salted ones."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:30], f"own{i}", *base[31:]])) for i in range(70)]
    rows += [(100 + i, " ".join([*base[:20], *(f"z{i}_{k}" for k in range(40))])) for i in range(30)]
    rows += [(200 + i, " ".join([*base[i : i + 40]])) for i in range(20)]
    assert got(make_docs(rows)) == brute(rows)
    assert got(make_docs(rows), salt_rows=4, part_rows=7) == brute(rows)
    assert got(make_docs(rows), part_rows=30) == brute(rows)


def test_repeated_and_null_ids(make_docs):
    """Rows are linked by their texts; a null id is none."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, a), (7, a), (7, b), (None, a), (None, a + " x"), (None, "alone here"), (None, None), (9, b), (4, b + " y")]
    out = sorted(((r[0], r[1], r[2]) for r in jaccard_components(make_docs(rows)).collect()), key=str)
    want = [(7, 36, 7), (7, 36, 7), (7, 36, 4), (None, 36, 7), (None, 37, 7), (None, 1, None), (None, 0, None), (9, 36, 4), (4, 37, 4)]
    assert out == sorted(want, key=str)


def test_unlike_sets_that_share_much(make_docs):
    """An open list: no two sets are similar enough, though all share rare n-grams."""
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join([*passage, *(f"q{i}_{k}" for k in range(12 + i % 5))])) for i in range(60)]
    rows += [(100 + i, " ".join([*passage, *(f"q{i}_{k}" for k in range(11 + i % 5))])) for i in range(0, 60, 7)]
    assert got(make_docs(rows)) == brute(rows)
    assert got(make_docs(rows), salt_rows=8, part_rows=16) == brute(rows)

def test_threshold_is_inclusive(make_docs):
    # Seven shingles of nine in common with eight: exactly 75 percent of some union.
    rows = [(i, " ".join(f"t{k}" for k in range(a, b))) for i, (a, b) in enumerate([(0, 16), (0, 13), (3, 16), (4, 16), (0, 4), (0, 3)])]
    assert got(make_docs(rows)) == brute(rows)


def test_empty(make_docs):
    assert got(make_docs([])) == {}
    assert got(make_docs([(5, None), (6, ""), (7, "  ")])) == {5: (0, 5), 6: (0, 6), 7: (0, 7)}
