"""Filter audit, chat formatting and hard negatives against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterweave.llm import chat, embeddings, filter_audit, hard_negatives

DOCS = "doc_id long, text string, source string, quality string, n long, mask int"


def _texts():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "", " \n ", "A B C D E", "x # y", "é ß İ", "word " * 300, " ".join(words), " ".join(words), "UP " + " ".join(words[:250]), " ".join(f"v{k}" for k in range(60_000))]
    for _ in range(150):
        some = rng.choice(words, rng.integers(100, 320)).tolist() if rng.random() < 0.5 else words[: rng.integers(150, 330)]
        if rng.random() < 0.3:
            some = [w.upper() for w in some]
        texts.append(" ".join(some) + (" $" if rng.random() < 0.3 else ""))
    return texts + texts[20:60]


def _audit(docs, labels):
    """Every order, filter by filter, document by document."""
    least = {}
    for k, t, *_ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good, toxic = ({k for k, *v in labels if k is not None and v[at] == 1} for at in (0, 1))
    seen = defaultdict(list)
    for k, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > least[t]}
        seen[s or ""].append((k, {x for x, v in fails.items() if v}))
    out, shapley = {}, defaultdict(int)
    for part, own in seen.items():
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                hit = [x for x in own if f in x[1]]
                out[part, order, step] = [len(left), len(gone), len(hit) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_that_of_every_order_applied(spark):
    rows = [(k, t, None if k % 7 == 0 else "" if k % 7 == 1 else f"s{k % 3}", "clash", 0, 1) for k, t in enumerate(_texts())]
    rows += [(8, rows[8][1], "s0", "", 0, 1), (8, rows[8][1], "s0", "", 0, 1), (None, rows[8][1], "s1", "", 0, 1), (None, None, "s1", "", 0, 1), (4, "another text of the same id", "s0", "", 0, 1)]
    labels = [(k, k % 2 if k % 5 else None, 1 if k % 11 == 0 else 2) for k in range(150)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    df, lab = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.filter_audit(df, lab).collect()}
    assert got == _audit(rows, labels)
    assert all(sum(v[-1] for (p, o, _), v in got.items() if p == part and o == "ABCDE") == 120 * sum(v[1] for (p, o, _), v in got.items() if p == part and o == "ABCDE") for part in {k[0] for k in got})
    assert filter_audit.filter_audit(df.limit(0), lab).count() == 0
    assert filter_audit.filter_audit(df, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_cells_are_whole_numbers_of_any_size(spark):
    rng = np.random.default_rng(1)
    cells = [int(x) for x in rng.integers(0, 1 << 40, 32)]
    counted = spark.createDataFrame([("p", False, False, m, n) for m, n in enumerate(cells)], "part string, good boolean, toxic boolean, mask int, n long")
    assert filter_audit.mask_cells(filter_audit.parity_sums(counted)).first()["all"] == cells


TURNS = "conv_id long, turn long, role string, text string, part int, target_start long"


def _turns():
    rows = [(1, 0, "system", "be </s> brief"), (1, 1, "user", "hi \\"), (1, 2, "assistant", "\\</s>\\\\[INST] <s>"), (1, 3, "user", None), (1, 4, "assistant", None), (1, 5, "assistant", "two replies"), (1, 6, "user", "last")]
    rows += [(2, 0, "user", "alone"), (3, None, "assistant", "first"), (3, 0, None, "role\nless"), (3, 0, "tool [/INST]\n", "x"), (3, 0, "tool [/INST]\n", "x")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} " + "é<|im_end|>" * (k % 40)) for k in range(1500)]
    rows += [(5, 0, "user", "long " * 60_000), (5, 1, "assistant", "[INST]" * 30_000), (None, 0, "user", "who"), (None, 1, "assistant", "none")]
    return [(*r, 1, 2) for r in rows]


@pytest.fixture
def spread(spark):
    """Small tables stay spread over tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_examples_hold_every_reply_once_and_all_before_it(spark, spread):
    rows = _turns()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    blocks, examples = chat.expand(df)
    by_conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by_conv[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.read_back(blocks, examples).collect()}
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort(key=lambda x: x[0]) if c != 3 else turns.sort(key=lambda x: (x[0], x[1]))
        replies = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.n_examples) == (len(turns), len(replies), sum(r == "assistant" for _, r, _ in turns))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    assert blocks.where("conv_id = 4").select("part").distinct().count() > 1  # spread over tasks
    # Examples written out: context is the formatted text of all turns before, target the reply.
    form = lambda r, x: chat.OPEN + r + chat.MIDDLE + x + chat.CLOSE
    esc = lambda x: re.sub("|".join(map(re.escape, chat.CONTROLS)), lambda m: "\\" + m[0], x)
    texts = {(r.conv_id, r.example): r for r in chat.example_texts(blocks, examples.where("conv_id in (1, 4) or conv_id is null")).collect()}
    for c in (1, 4, None):
        done, k = "", 0
        for _, r, x in by_conv[c]:
            if r == "assistant":
                e = texts[c, k]
                assert e.context == done + chat.OPEN + r + chat.MIDDLE and chat.unescape(e.target) == x
                k += 1
            done += form(esc(r), esc(x))
    assert len(texts) == 3 + 750 + 1


def test_control_strings_stand_alone_only_in_the_template(spark):
    blocks, examples = chat.expand(spark.createDataFrame(_turns(), TURNS))
    rows = blocks.select("text", "n_turns").collect()
    for c, per in (("<s>", 1), ("</s>", 1), ("[INST]", 1), ("[/INST]", 1), ("<|im_end|>", 0)):
        assert sum(len(re.findall(r"(?<!\\)" + re.escape(c), r.text)) for r in rows) == per * sum(r.n_turns for r in rows)
    blocks, examples = chat.expand(spark.createDataFrame([], TURNS))
    assert blocks.count() == examples.count() == chat.read_back(blocks, examples).count() == 0


VECTORS = "vec_id long, label long, embedding array<double>, id int, q string"


def _mined(rows, anchors):
    best = {}
    for k, y, v in rows:
        if k is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own = (y, [int(np.floor(256 * x)) for x in v])
            best[k] = min(own, best.get(k, own))
    out = {}
    for a, (y, q) in best.items():
        if not anchors(a):
            continue
        score = {b: sum(i * j for i, j in zip(q, p)) for b, (_, p) in best.items() if b != a and len(p) == len(q)}
        same = sorted((b for b in score if best[b][0] == y), key=lambda b: (-score[b], b))[:5]
        for p in same:
            fits = sorted((b for b in score if best[b][0] != y and 80 * score[p] <= 100 * score[b] <= 100 * score[p]), key=lambda b: (-score[b], b))[:5]
            out.update({(a, p, n): (b, score[p], score[b]) for n, b in enumerate(fits, 1)})
    return out


@pytest.mark.parametrize("tile", [50, 4096])
def test_negatives_are_those_of_every_product(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12))
    rows = [(k, int(rng.integers(0, 4)) if k % 3 else 0, (base[rng.integers(0, 6)] + 0.3 * rng.normal(size=12)).tolist()) for k in range(400)]
    rows += [(1000 + k, k % 3, rows[0][2]) for k in range(120)]  # ties
    rows += [(2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [float("nan")] * 12), (2003, 1, [None] + [1.0] * 11), (2004, 1, [float("inf")] * 12), (2005, 1, []), (None, 1, rows[0][2]), (2006, 1, [1.0, 2.0]), (2010, 2, [1.0, 2.5]), (2020, 1, [3.0, 2.0]), (10, 3, rows[0][2]), (2030, 1, [0.0] * 12), (20, *rows[20][1:])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, rows_per_tile=tile, anchors_per_tile=tile // 2).collect()
    want = _mined(rows, lambda k: k % 10 == 0)
    assert {(r.anchor_id, r.positive_id, r.rank): (r.negative_id, r.positive_score, r.negative_score) for r in got} == want and len(got) == len(want) > 200
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.col("id") < 0).count() == 0


def test_bounds_drop_most_pairs_and_none_that_counts():
    rng = np.random.default_rng(9)
    import pyarrow as pa

    q = np.floor(256 * (rng.normal(size=(2000, 64)) * np.geomspace(1, 0.02, 64))).astype(int)
    axes = np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1]
    r = hard_negatives._Rotated(pa.array(q.tolist()), axes)
    a = hard_negatives._Rotated(pa.array(q[:50].tolist()), axes)
    exact = q[:50] @ q.T
    least = np.sort(exact, axis=1)[:, -20]
    checked = []

    def need(low, high, live):
        checked.append(live.sum())
        return high >= least[:, None]

    i, j, score = hard_negatives.survivors(a, r, slice(0, 2000), np.ones((50, 2000), bool), need)
    assert (score == exact[i, j]).all() and set(zip(*np.nonzero(exact >= least[:, None]))) <= set(zip(i, j))
    assert checked[1] < 0.5 * checked[0] and checked[-1] < 0.1 * checked[0]


def test_vectors_of_any_size_link(spark):
    angle = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    rows = [(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angle)]
    rows += [(1000, [1e-200, 0.0]), (1001, [1e200, 0.0]), (1002, [5e-324, 0.0]), (1003, [-1e308, 1e308]), (1004, [1e-200, 1e200])]
    got = {r.vec_id: r for r in embeddings.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=50).collect()}
    x = np.array([v for _, v in rows[:400]] + [[1, 0], [1, 0], [1, 0], [-(0.5**0.5), 0.5**0.5], [0, 1]])
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert [got[k].n_links for k, _ in rows] == links.tolist()
    assert {r.component_id for r in got.values()} == {0}
