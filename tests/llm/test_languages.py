"""Machines and votes of the language model against plain loops."""

import numpy as np

from rallyline.llm import langid


def objective(w, x, y, ridge):
    n = {side: sum(1 for v in y if v == side) for side in (1.0, -1.0)}
    loss = 0.0
    for row, side in zip(x, y):
        margin = side * (sum(a * b for a, b in zip(row, w[:-1])) + w[-1])
        loss += 0.5 / n[side] * max(0.0, 1.0 - margin) ** 2
    return loss + ridge / 2 * sum(v * v for v in w)


def test_a_machine_is_the_least_of_its_objective():
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((40, 6))) + np.repeat([[1, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0]], [12, 28], 0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    y = np.repeat([1.0, -1.0], [12, 28])
    w = langid.machine(x, y, rounds=3000)
    least = objective(w, x, y, 1e-3)
    for i in range(len(w)):  # no step in any direction makes it less
        for step in (1e-3, -1e-3):
            moved = w.copy()
            moved[i] += step
            assert objective(moved, x, y, 1e-3) > least - 1e-9
    assert objective(langid.machine(x, y), x, y, 1e-3) < 1.02 * least + 1e-3
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.8


def test_the_most_votes_win_and_margins_break_ties():
    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "d"]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    level = langid.Level(names, pairs, rng.standard_normal((len(pairs), 9)))
    x = rng.standard_normal((200, 8))
    best, score = level.predict(x)
    for row, got, sure in zip(x, best, score):
        votes, soft = [0] * 4, [[] for _ in names]
        for (i, j), w in zip(pairs, level.weights):
            p = 1 / (1 + np.exp(-4 * (row @ w[:-1] + w[-1])))
            votes[i if p > 0.5 else j] += 1
            soft[i].append(p)
            soft[j].append(1 - p)
        most = [i for i in range(4) if votes[i] == max(votes)]
        assert got == max(most, key=lambda i: sum(soft[i])) and np.isclose(sure, min(soft[got]))


def test_families_decide_before_languages():
    """A text goes to a language of the family that wins, however sure another family's languages would be."""
    one = lambda names, w: langid.Level(names, [(0, 1)], np.array([[*w, 0.0]]))
    model = langid.Hierarchy(one(["f", "g"], (1, 0)), {"f": one(["f1", "f2"], (0, 1)), "g": one(["g1", "g2"], (0, 1))})
    names, score = model.predict(np.array([[2.0, 5.0], [2.0, -5.0], [-0.1, 5.0]]))
    assert names == ["f1", "f2", "g1"] and score[0] > 0.99 > score[2]
