import itertools
import random

from quoin.llm.packing import _Stock, best_fit, bin_completion, fill, fillings, pack, places, waste_bound


def histogram(sizes, capacity):
    c = [0] * (capacity + 2)
    for s in sizes:
        c[s] += 1
    return c


def optimum(sizes, capacity):
    """Fewest containers by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def valid(fills, sizes, capacity):
    assert all(sum(s * k for s, k in f.items) <= capacity for f in fills)
    got = sorted(itertools.chain(*([s] * (k * f.copies) for f in fills for s, k in f.items)))
    assert got == sorted(sizes)


def test_against_every_packing():
    rng = random.Random(2)
    at_best = 0
    for _ in range(60):
        cap = rng.choice((10, 17, 30))
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        c = histogram(sizes, cap)
        valid(best_fit(list(c), cap), sizes, cap)
        fills = bin_completion(list(c), cap)
        valid(fills, sizes, cap)
        least = optimum(sizes, cap)
        assert waste_bound(c, cap) <= least <= sum(f.copies for f in fills) <= sum(f.copies for f in best_fit(list(c), cap))
        at_best += sum(f.copies for f in fills) == least
    assert at_best >= 58


def test_completion_beats_best_fit():
    sizes = [6] * 4 + [5] * 4 + [4] * 4 + [3] * 4 + [2] * 4
    c = histogram(sizes, 10)
    assert sum(f.copies for f in bin_completion(c, 10)) == 8 == waste_bound(c, 10)


def test_all_undominated_fillings():
    got = list(fillings(_Stock(histogram([7, 3, 2, 1, 5], 10)), 10))
    assert got == [(0, ((7, 1), (3, 1)))]  # 2 + 1 and less leave room that 3 fills
    stock = _Stock(histogram([6, 4, 3, 3, 1, 1], 10))
    before = list(stock.counts)
    assert [w for w, _ in fillings(stock, 10)] == [0] and stock.counts == before
    rng = random.Random(6)
    for _ in range(40):  # a best packing is among the undominated fillings
        sizes = [rng.randint(1, 9) for _ in range(6)]
        stock = _Stock(histogram(sizes, 10))
        big, found = max(sizes), [items for _, items in fillings(stock, 10)]
        rest = [optimum(_without(sizes, items), 10) for items in found]
        assert found and all(items[0][0] == big for items in found) and 1 + min(rest) == optimum(sizes, 10)


def _without(sizes, items):
    left = sorted(sizes)
    for s, k in items:
        for _ in range(k):
            left.remove(s)
    return left


def test_places_number_every_document():
    fills = bin_completion(histogram([5, 5, 5, 3, 2, 2], 10), 10)
    at = places(fills, 100)
    assert {s: int((e * 1).sum()) >= 1 for s, (_, _, e) in at.items()}.keys() == {5, 3, 2}


def test_documents(spark):
    texts = [(1, "word " * 30), (1, "word " * 30), (2, None), (3, ""), (4, "word " * 95), (5, "one two"), (None, "x"), (6, "word " * 40)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, capacity string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 20), (2, "piece_bpe_32k", 64), (3, "word_bpe_49k", 64), (4, None, 3), (5, "byte_bpe_50k", 0)], "spec_id int, tokenizer string, capacity int")
    got = pack(docs, specs)
    rows = got.collect()
    for spec, cap in ((1, 20), (2, 64), (3, 64)):
        mine = [r for r in rows if r.spec_id == spec]
        by = {}
        for r in mine:
            by[r.container_id] = by.get(r.container_id, 0) + r.tokens
            assert r.piece_no == 0 or r.first_token == r.piece_no * cap
        assert all(v <= cap for k, v in by.items() if k is not None) and by[None] == 0
        assert sorted(k for k in by if k is not None) == list(range(len(by) - 1))
        assert len([r for r in mine if r.tokens == 0]) == 2
        whole = {i: sum(r.tokens for r in mine if r.doc_id == i) for i in (4, 6)}
        assert whole[4] > whole[6] > 0
    assert sum(r.tokens for r in fill(got, specs).collect()) == sum(r.tokens for r in rows)
    assert pack(docs.limit(0), specs).count() == 0 and pack(docs, specs.limit(0)).count() == 0
