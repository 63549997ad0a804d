"""Registered queries without SQL, called as the driver calls them, against the contract's columns by plain Python."""

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
import tiktoken
import xxhash
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from quarterweave.llm import tokens
from quarterweave.llm.queries import QUERIES

STORY = " ".join(f"The{k} Quick{k * k % 89} é{k}" for k in range(150))
TEXTS = {
    3: None, 5: "", 8: " \t\n", 21: STORY, 34: STORY.upper(), 55: STORY + " once more", 89: "one two", 90: "ONE two", 144: "ends in two\n\n", 233: "x <|endoftext|> y  \n z",
    377: " ".join(f"w{k * k % 9973}" for k in range(25_000)), 610: "日本語 ß İ it's     end", 987: "\x0b a\x1cb \x85", 1597: "same " * 300,
}
TEXTS |= {2000 + k: " ".join(f"t{k}n{j}" for j in range(40 * k + 1)) for k in range(60)}
LIMIT = 2048


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 12))
    rows = [(int(k) * 3, v.tolist()) for k, v in enumerate(base[rng.integers(0, 25, 200)] + 0.2 * rng.normal(size=(200, 12)))]
    rows += [(900, None), (901, [0.0] * 12), (902, [float("inf")] + [1.0] * 11), (903, rows[0][1]), (904, [x * 2 for x in rows[0][1]])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"file://{at}/embeddings.parquet")
    return f"file://{at}", rows


def groups(near):
    """The smallest index that each index reaches."""
    label = np.arange(len(near))
    while not np.array_equal(new := np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1)), label):
        label = new
    return label


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def result(spark, tables, name, **types):
    out = QUERIES[name](spark, tables[0])
    assert {c: t for c, t in out.dtypes if c in types} == types
    return out.collect()


def test_op1_sections_add_up_to_the_whole_text(spark, tables):
    enc, total = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={}), dict.fromkeys(TEXTS, 0)
    for r in result(spark, tables, "op1_token_counts", doc_id="bigint", n_tokens="bigint"):
        total[r.doc_id] += r.n_tokens
    assert total == {k: len(enc.encode_ordinary(t or "")) for k, t in TEXTS.items()}


def test_op3_links_and_components(spark, tables):
    got = {r.vec_id: r for r in result(spark, tables, "op3_cover_tree", vec_id="bigint", n_links="bigint", component_id="bigint", kept="boolean")}
    rows = tables[1]
    own = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k not in (900, 901, 902)]
    x = np.array([v / np.linalg.norm(v) for _, v in own])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = np.array([k for k, _ in own])  # in ascending order, so the smallest index is the smallest id
    want = {int(k): (int(n), int(ids[g])) for k, n, g in zip(ids, near.sum(axis=1), groups(near), strict=True)} | {k: (0, k) for k in (900, 901, 902)}
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want and all(r.kept == (k == r.component_id) for k, r in got.items())
    assert got[904].n_links > 0


def test_op4_digests_are_those_of_the_library(spark, tables):
    enc = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})
    rows = result(spark, tables, "op4_merge_replay", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    assert sorted(r.doc_id for r in rows) == sorted(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op5_reads_back_every_document(spark, tables):
    library, start, want = Tokenizer.from_file(path("word_bpe_49k.json")), 0, {}
    for k in sorted(TEXTS):
        ids = [*library.encode(TEXTS[k] or "", add_special_tokens=False).ids, 2]
        want[k] = (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    rows = result(spark, tables, "op5_id_files", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    assert len(rows) == len(want) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op8_fingerprints_and_components(spark, tables):
    ids = sorted(TEXTS)
    prints = [fingerprint(TEXTS[k]) for k in ids]
    label = groups(np.array([[a != b and (prints[a] ^ prints[b]).bit_count() <= 4 for b in range(len(ids))] for a in range(len(ids))]))
    rows = result(spark, tables, "op8_simhash", doc_id="bigint", fingerprint="string", component_id="bigint")
    assert len(rows) == len(ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got == {k: (f"{p:016x}", ids[g]) for k, p, g in zip(ids, prints, label.tolist(), strict=True)}
    assert got[3] == got[5] == got[8] == ("0" * 16, 3) and got[90][1] == 89


def best_fit_decreasing(lengths):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        insort(gaps, (gaps.pop(at) if at < len(gaps) else LIMIT) - n)
    return len(gaps)


def test_op9_packs_every_piece(spark, tables):
    library, want = Tokenizer.from_file(path("word_bpe_49k.json")), {}
    for k, t in TEXTS.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want |= {(k, p): (s, len(ids[s : s + LIMIT]), zlib.crc32(raw(ids[s : s + LIMIT]))) for p, s in enumerate(range(0, len(ids), LIMIT))}
    rows = result(spark, tables, "op9_best_fit", doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    assert len(rows) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= LIMIT and len(filled) <= best_fit_decreasing([n for _, n, _ in want.values()])
