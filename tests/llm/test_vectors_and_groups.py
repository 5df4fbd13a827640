import random

import numpy as np
import pytest

from docketlake.llm import neardup, neighbours, packing, pieces


def brute(x, groups, ids, k):
    pairs = set()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(x)):
        mates = [j for j in range(len(x)) if groups[j] == groups[i] and j != i]
        pairs |= {(ids[i], ids[j]) for j in sorted(mates, key=lambda j: (-round(float(unit[i] @ unit[j]), 9), ids[j]))[:k]}
    return pairs


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=(n, 16)) * rng.uniform(0.2, 3, (n, 1)) + 0.5
    groups = ["a" if i % 3 else "b" for i in range(n)]
    rows = [(i, groups[i], x[i].tolist()) for i in range(n)]
    rows += [(-1, "a", None), (-2, "a", [0.0] * 16), (-3, "a", [1.0]), (-4, None, [1.0] * 16), (None, "a", [1.0] * 16), (-5, "a", [float("nan")] * 16)]
    rows += [(n + i, "small", rng.normal(size=16).tolist()) for i in range(4)] + [(n + 9, "alone", [1.0] * 16)]
    table = spark.createDataFrame(rows, "id long, kind string, v array<float>").repartition(6)
    # several blocks in a group
    found = neighbours.nearest(table, "id", "v", ("kind",), dim=16, stages=8, block=500, sample=1500).collect()
    got = {(r.id, r.neighbour) for r in found if r.id < n}
    want = brute(x, groups, list(range(n)), 10)
    assert len(got) == len(want) and len(got & want) / len(want) > 0.97
    assert len([r for r in found if r.id >= n]) == 4 * 3 and not [r for r in found if r.id < 0]
    assert {r["rank"] for r in found if r.id == n} == {1, 2, 3}


def test_blocks_of_any_number_find_the_same(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 16))
    rows = [(i, x[i].tolist()) for i in range(1200)] + [(5, x[5].tolist()), (6, x[7].tolist())]
    table = spark.createDataFrame(rows, "id long, v array<float>")
    found = [
        {(r.id, r["rank"]): r.neighbour for r in neighbours.nearest(table, "id", "v", dim=16, stages=8, margin=9, block=block, largest=block).collect()} for block in (10_000, 700, 130)
    ]
    assert len(found[0]) == 12_000 and found[0] == found[1] == found[2]
    assert all(id_ != other for (id_, _), other in found[0].items())


def test_equal_similarities_go_to_the_smaller_id(spark):
    table = spark.createDataFrame([(i, [1.0, 0.0] if i else [1.0, 0.1]) for i in range(30)], "id long, v array<float>")
    found = [r.neighbour for r in neighbours.nearest(table, "id", "v", dim=2, stages=2).where("id = 0").orderBy("rank").collect()]
    assert found == list(range(1, 11))


def test_no_vectors_no_neighbours(spark):
    assert neighbours.nearest(spark.createDataFrame([], "id long, v array<float>"), "id", "v", dim=4).count() == 0


def test_encoding_comes_nearer_with_each_stage():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    left = [neighbours.encode(x, neighbours.train(x, s))[1].mean() for s in (1, 2, 4)]
    assert left[0] > left[1] > left[2]
    books = neighbours.train(x, 3)
    codes, residual = neighbours.encode(x, books)
    assert np.allclose(np.linalg.norm(x - sum(books[m][codes[:, m]] for m in range(3)), axis=1), residual, atol=2e-3)


def jaccard(a, b, width):
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_texts():
    random.seed(5)
    texts = []
    for _ in range(40):
        base = [f"w{random.randint(0, 3000)}" for _ in range(60)]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 5, 12):
            words = list(base)
            for _ in range(edits):
                words[random.randrange(60)] = "X" + str(random.random())[2:6]
            texts.append(" ".join(words))
    return texts


def test_similar_pairs_equal_brute_force(spark):
    texts = near_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "poucas palavras"), (None, texts[0])]
    table = spark.createDataFrame(rows, "id long, t string").repartition(5)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j], 3) >= 0.65}
    for most in (2000, 2):
        got = [(r.id_a, r.id_b) for r in neardup.similar_pairs(table, "id", "t", threshold=0.65, width=3, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_text_with_many_candidates_is_met_with_all_of_them(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(1, 70)]
    table = spark.createDataFrame(rows, "id long, t string").repartition(4)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if jaccard(rows[i][1], rows[j][1], 3) >= 0.8}
    near = spark.createDataFrame([(i, j) for i in range(70) for j in range(i + 1, 70)], "class_a long, class_b long")
    texts = table.selectExpr("id", "t as content")
    for block in (256, 7):
        got = {(r.class_a, r.class_b) for r in neardup._verified(near, texts, 0.8, 3, 20, block).collect()}
        assert got == want and len(want) > 1000
    crowd = spark.createDataFrame([(i, " ".join(base)) for i in range(1500)], "id long, t string")
    assert neardup.similar_pairs(crowd, "id", "t").count() == 1500 * 1499 // 2


def test_groups_have_one_row_for_each_text(spark):
    texts = near_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = neardup.similar_groups(table, "id", "t", threshold=0.65, width=3).collect()
    assert len({r.id for r in rows}) == len(rows)
    by = {r.id: r for r in rows}
    assert by[0].group_id == 0 and by[1].class_id == 0 and by[1].links == by[0].links > 0
    assert neardup.similar_groups(table.limit(0), "id", "t").count() == 0


def test_min_max_signatures_estimate_the_similarity():
    a, b = (neardup.shingle_sets([" ".join(f"w{i}" for i in range(s, s + 300))], 1, 1)[0] for s in (0, 100))
    permutations = neardup._permutations(1500, 3)
    same = (neardup.signature(a, permutations) == neardup.signature(b, permutations)).mean()
    assert same == pytest.approx(0.5, abs=0.04)


def test_containers_are_full_and_whole(spark):
    random.seed(2)
    sizes = [random.choice([random.randint(1, 900), random.randint(1, 2048)]) for _ in range(3000)] + [5000, 2048, 2049]
    table = spark.createDataFrame(list(enumerate(sizes)) + [(9000, 0)], "id long, n_tokens long")
    rows = packing.containers(table, 2048, 1000).collect()
    used, pieces_of = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        pieces_of.setdefault(r.id, []).append(r.n_tokens)
    assert max(used.values()) <= 2048
    assert {i: sum(v) for i, v in pieces_of.items()} == dict(enumerate(sizes))
    assert all(len(pieces_of[i]) == 1 for i, n in enumerate(sizes) if n <= 2048) and len(pieces_of[3000]) == 3
    assert sum(used.values()) / (2048 * len(used)) > 0.97


def test_fullest_equals_brute_force():
    random.seed(4)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(4)}
        room = random.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        taken = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(taken) == max(sums) and all(taken.count(x) <= counts[x] for x in taken)


@pytest.mark.parametrize("text", ["a" * 30000, "Uma frase curta. " * 1500, ("palavra " * 40 + "\n\n") * 90, "é" * 9000, "x " * 4001])
def test_pieces_overlap_and_hold_everything(text):
    text = text.strip()
    places = pieces.cuts(text, 8000, 200)
    assert places[0][0] == 0 and places[-1][1] == len(text)
    assert all(b - a <= 8000 for a, b in places) and all(b[0] == a[1] - 200 for a, b in zip(places, places[1:]))
    parts = [text[a:b] for a, b in places]
    assert parts[0] + "".join(p[200:] for p in parts[1:]) == text
    if ". " in text:
        assert all(p.endswith(".") for p in parts)


def test_only_oversized_texts_are_split(spark):
    rows = [(1, None, "f"), (2, "", "f"), (3, " " * 9000, "f"), (4, "a" * 8000 + "  ", "f"), (5, "b" * 8001, None), (5, "b" * 8001, None)]
    made = pieces.split_oversized(spark.createDataFrame(rows, "id long, t string, file string"), "id", "t", ("file",)).collect()
    assert [r.id for r in made] == [5] * 4 and {r.n_pieces for r in made} == {2}
    with pytest.raises(ValueError):
        pieces.cuts("x" * 100, 10, 5)
