"""The corpus pipeline against a plain version of every stage, in Python and numpy, over one small corpus."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from quarterweave.llm import quality, surrogates, tokens

DDL = "doc_id long, text string, lang string, source string, n_chars long, n_words string, extra int"
KEY = "a key for tests"


def corpus():
    rng = np.random.default_rng(11)
    pool = [f"{a}{b}" for a in "the of an in er on re ti st en".split() for b in "ha li no ra mo se tu vi ke po".split()]
    prose = lambda n: [str(x) for x in rng.choice(pool, n)]
    texts: dict[int, str | None] = {}
    for k in range(160):
        w = prose(int(rng.integers(60, 140)))
        texts[k] = "\n".join(" ".join(w[i : i + 15]) for i in range(0, len(w), 15))
    for k in range(160, 200):  # exact copies and copies with a word changed
        w = texts[k - 150].split(" ")
        if k % 2:
            w[len(w) // 2] = "changed"
        texts[k] = " ".join(w)
    passage = " ".join(prose(55))
    for k in range(200, 215):
        texts[k] = " ".join(prose(40)) + " " + passage + " " + " ".join(prose(40))
    for k in range(215, 225):
        texts[k] = " ".join(prose(30)) + f" write to Ann.{k % 3}@mail.org or +1 (555) 010-0{k} of Mr. John Smith's {k}; password=abc{k}def " + " ".join(prose(40))
    for k in range(225, 235):
        texts[k] = " ".join(x + "$$$" for x in prose(70))
    texts |= {235: "too short", 236: None, 237: "", 238: " ".join(prose(30_000)), 239: "again and over " * 60, 240: "x" * 3_000_000 + " " + " ".join(prose(70))}
    rows = [(k, t, None if k % 50 == 7 else "en" if k % 3 else "de", None if k % 40 == 9 else f"s{k % 2}", len(t or ""), "clash", 1) for k, t in texts.items()]
    rows += [(5, texts[5], "en", "s1", len(texts[5]), "", 2), (6, texts[9], "en", "s1", 0, "", 2), (None, texts[3], "en", "s1", 0, "", 2), (None, texts[3], "en", "s1", 0, "", 2)]
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_quality(rows):
    gamma = math.log((1 + quality.ERROR) / (1 - quality.ERROR))
    measured = []
    for row in rows:
        text, w = row[1] or "", words(row[1])
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        covered = len({j for i, x in enumerate(tri) if n[x] > 1 for j in range(i, i + 3)})
        lines = [x for x in text.split("\n") if words(x)]
        chars, per = sum(map(len, w)), lambda a, b: a / b if b else 0.0
        measured.append((row, len(w), covered, {
            "m_word_length": per(chars, len(w)), "m_symbols": per(len(re.findall(r"[#*$%&|<>]", text)), chars), "m_dup_lines": per(len(lines) - len(set(lines)), len(lines)),
            "m_repeats": per(covered, len(w)), "m_upper": per(sum(c.isupper() for c in text), chars), "m_loud": per(sum(x.endswith("!") for x in w), len(w)), "m_marks": per(chars - sum(unicodedata.category(c)[0] in "LM" for c in text), chars),
        }))
    limits = {}
    for level in range(3):  # all, language, language and source
        groups = defaultdict(list)
        for row, *_, m in measured:
            groups[() if level == 0 else row[2:3] if level == 1 else row[2:4]].append(m)
        for key, own in groups.items():
            for name, fence in quality.FENCES.items():
                buckets = sorted(max(math.ceil(math.log(m[name]) / gamma) + 100_000, 1) for m in own if m[name] > 0)
                if not buckets:
                    continue
                at = lambda q: (buckets[math.ceil(q * len(buckets)) - 1] - 100_000 - 0.5) * gamma  # noqa: E731, B023
                centre, spread, n = at(0.5), at(0.75) - at(0.5), len(buckets)
                if level:
                    up = limits[key[:-1], name]
                    centre, spread = ((n * x + quality.PRIOR * y) / (n + quality.PRIOR) for x, y in zip((centre, spread), up, strict=False))
                limit = math.exp(centre + fence * max(spread, gamma))
                limits[key, name] = centre, spread, min(limit, quality.LIFT * up[2]) if level else limit
    most = lambda row, x: limits.get((row[2:4], quality.JUDGED[x]), (0, 0, math.inf))[2]
    return [row[:5] for row, n, covered, m in measured if n >= 50 and 2 * covered <= n and all(m[x] <= most(row, x) for x in quality.JUDGED)]


def plain_near(rows):
    def print_of(text):
        w = (text or "").encode().lower().split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))

    prints = [print_of(r[1]) for r in rows]
    label = [r[0] for r in rows]
    while True:
        before = list(label)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if label[i] is not None and label[j] is not None and (a ^ b).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
        if label == before:
            return [r for r, own in zip(rows, label, strict=True) if own is None or own == r[0]]


def plain_substring(rows):
    first: dict[tuple, int] = {}
    split = [words(r[1]) for r in rows]
    for r, w in zip(rows, split, strict=True):
        for i in range(len(w) - 12 if r[0] is not None else 0):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - 12 if r[0] is not None else 0) if first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        text = r[1] if not gone else " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone or len(gone) < len(w):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    spark.conf.set(surrogates.KEY_SETTING, KEY)
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(corpus(), DDL).repartition(5).write.parquet(f"{path}/documents.parquet")
    docs, results = spark.read.parquet(f"{path}/documents.parquet"), [corpus()]
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, path), name)
        results.append(rows_of(docs))
        last = docs.columns
    yield path, results, last
    spark.conf.unset(surrogates.KEY_SETTING)


def test_every_stage_keeps_what_a_plain_version_keeps(chain):
    _, (given, kept, unique, cut, hidden, _), _ = chain
    assert order(kept) == order(plain_quality(given)) and {r[0] for r in kept}.isdisjoint({*range(225, 238), 239, 240})
    assert order(unique) == order(plain_near(kept)) and len(unique) <= len(kept) - 20
    assert order(cut) == order(plain_substring(unique)) and sum(len(r[1]) for r in cut) < sum(len(r[1]) for r in unique)
    holds = lambda r: r[0] is not None and 215 <= r[0] < 225
    after = {r[0]: r for r in hidden if holds(r)}
    assert order([(*r[:4], len(r[1])) for r in cut if not holds(r)]) == order([r for r in hidden if not holds(r)])
    assert len(hidden) == len(cut) and sum("@mail.org" in r[1] for r in cut) == 10
    mails, found = {}, 0
    shape = r"(.* write to )(\S+)( or )(\+.*?)( of Mr\. )(\w+) (\w+)('s \d+; password=)(\w+)( .*)"
    for r in filter(holds, cut):  # the same text but for what was found
        new = after[r[0]]
        m, old = re.fullmatch(shape, new[1], re.S), re.fullmatch(shape, r[1], re.S)
        assert [m[k] for k in (1, 3, 5, 8, 10)] == [old[k] for k in (1, 3, 5, 8, 10)] and all(m[k] != old[k] for k in (2, 4, 6, 7, 9))
        mails.setdefault(old[2].lower(), set()).add(m[2])
        found += 1
        assert new[2:4] == r[2:4] and new[4] == len(new[1])
    assert found == 10 and all(len(x) == 1 for x in mails.values()) and len(set.union(*mails.values())) == len(mails) == 3


def test_packing_keeps_every_id_in_as_few_sequences_as_can_be(chain):
    _, results, names = chain
    pieces = [dict(zip(names, r, strict=True)) for r in results[-1]]
    fresh = Tokenizer.from_file(tokens.WORD_BPE)
    want, total = Counter(), 0
    for doc, text, *_ in results[-2]:
        ids = [*fresh.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        want.update((doc, k, lo, np.array(ids[lo : lo + 2048], "<u4").tobytes()) for k, lo in enumerate(range(0, len(ids), 2048)))
    assert Counter((p["doc_id"], p["piece"], p["start"], bytes(p["ids"])) for p in pieces) == want
    place = defaultdict(list)
    for p in pieces:
        place[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in map(sorted, place.values()):
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(place) <= -(-total // 2048) + 1


def test_run_is_the_chain_of_its_stages(spark, chain):
    path, results, names = chain
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, path)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    own = [k for k, c in enumerate(names) if c not in ("sequence_id", "offset")]
    pick = lambda rows: order([tuple(r[k] for k in own) for r in rows])
    assert out.columns == names and pick(rows_of(out)) == pick(results[-1])


def test_an_empty_table_gives_no_sequences(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
