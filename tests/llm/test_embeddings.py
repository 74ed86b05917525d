import math
import random

from quoteflow.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int, node int, packed int, id int, links int"


def brute(rows, threshold):
    def valid(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        m, n = max(map(abs, a)), max(map(abs, b))
        a, b = [x / m for x in a], [x / n for x in b]
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))

    links = {k: [j for j, (_, w) in enumerate(rows) if j != k and valid(v) and valid(w) and len(v) == len(w) and cosine(v, w) >= threshold] for k, (_, v) in enumerate(rows)}
    out = []
    for k in links:
        seen, queue = {k}, [k]
        while queue:
            for j in links[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        own = rows[k][0]
        out.append((own, len(links[k]), low, own is not None and own == low))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 7)
    monkeypatch.setattr(embeddings, "PAIRS", 5)
    rnd = random.Random(7)
    rows = []
    for c in range(12):
        centre = [rnd.gauss(0, 1) for _ in range(8)]
        for _ in range(8):
            noise = rnd.choice([0.02, 0.2, 0.35])
            rows.append((len(rows), [x + rnd.gauss(0, noise) for x in centre]))
    rows += [(200 + k, list(rows[k][1])) for k in range(10)] + [(300, [2 * x for x in rows[0][1]]), (301, [1e-200 * x for x in rows[1][1]]), (302, [1e200 * x for x in rows[2][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("nan")] * 8), (405, [float("inf")] + [1.0] * 7)]
    rows += [(500, [1.0, 2.0]), (501, [1.0, 2.1]), (None, [1.0, 2.0]), (None, [-5.0, 0.5]), (501, [1.0, 2.1]), (502, [-1.0, -2.0])]
    frame = spark.createDataFrame([(i, v, *[None] * 5) for i, v in rows], SCHEMA)
    for block in (10_000, 20):
        got = embeddings.near_duplicates(frame, threshold=0.9, block=block).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == brute(rows, 0.9)
    assert embeddings.near_duplicates(frame.where("false")).collect() == []


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (3, 64, 300):
        x = rng.standard_normal((200, size)) * rng.choice([0.01, 1, 30], (200, size))
        side = embeddings._Side([r.tobytes() for r in x])
        estimate = (side.whole @ side.whole.T) * side.scale[:, None] * side.scale
        bound = side.length[:, None] * side.error + side.error[:, None]
        assert (np.abs(side.unit @ side.unit.T - estimate) <= bound + 1e-6).all()
