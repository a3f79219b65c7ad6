import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkloom.llm import mixing, pieces, tokens

from .helpers import documents_dir, rows, table

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_codes_give_any_token():
    ids = np.random.default_rng(0).integers(0, 70000, 3000).astype(np.uint32)
    ids[::5] %= 200
    codes = tokens.Codes.loaded([dict(x) for x in tokens.Codes.encode(ids).stored()])
    assert (codes.decode() == ids).all()
    assert [codes[i] for i in range(0, 3000, 7)] == ids[::7].tolist()


def test_op1_matches_the_library(spark, tmp_path):
    data = rows()[:-2]
    folder = documents_dir(table(spark, data), tmp_path)
    tok = Tokenizer.from_file(BPE)
    start, want = 0, {}
    for key, text, *_ in sorted(data, key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op1_token_codes(spark, folder).collect()}
    assert got == want


def test_random_access_and_small_segments(spark, tmp_path):
    path = str(tmp_path / "codes")
    tokens.encode_tokens(table(spark, rows()[:-2]), path, BPE, segment_tokens=50)
    back = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, path).collect()}
    for key in (-3, 60, 67):
        assert [tokens.token_at(spark, path, key, i) for i in (0, len(back[key]) - 1, len(back[key]))] == [back[key][0], 2, None]


def test_repeated_and_null_keys_and_empty_tables(spark, tmp_path):
    tokens.encode_tokens(table(spark), str(tmp_path / "a"), BPE)
    assert tokens.read_tokens(spark, str(tmp_path / "a")).count() == len(rows())
    tokens.encode_tokens(table(spark, []), str(tmp_path / "b"), BPE)
    assert tokens.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_op4_matches_the_library(spark, tmp_path):
    folder = documents_dir(table(spark, rows()[:-2]), tmp_path)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for key, text, *_ in rows()[:-2]:
        ids = [*sp.encode(text or ""), 2]
        want[key] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.op4_pieces(spark, folder).collect()}
    assert got == want
    assert pieces.encode_pieces(table(spark, []), PIECES).count() == 0
    assert pieces.encode_pieces(table(spark), PIECES).count() == len(rows())


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, live = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and live:
        unit = left / sum(w[s] for s in live)
        for s in live:
            target[s] += unit * w[s]
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in live)
        over = {s for s in live if target[s] >= most * sizes[s]}
        for s in over:
            target[s] = float(most * sizes[s])
        live -= over
    return target


MIXES = {
    "awkward": rows,
    "empty": list,
    "one full": lambda: [(i, "w " * (1 + i % 5), "en", f"s{min(i, 4)}", 0, 0, "") for i in range(300)],
    "even": lambda: [(i, "w " * (1 + i % 5), "en", f"s{i % 7}", 0, 0, "") for i in range(700)],
    "hot": lambda: [(i, "w " * (1 + i % 5), "en", f"s{(i % 3) and i % 20}", 0, 0, "") for i in range(900)],
    "one source": lambda: [(i, "w w", "en", None, 0, 0, "") for i in range(50)],
}


@pytest.mark.parametrize("case", MIXES)
def test_op9_targets_and_copies(spark, tmp_path, case):
    data = MIXES[case]()
    folder = documents_dir(table(spark, data), tmp_path)
    got = mixing.op9_mixing(spark, folder).collect()
    sizes: dict = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    source = {}
    for r in data:
        source.setdefault(r[0], r[3])
    assert len(got) == len(data)
    taken: dict = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
    if case in ("even", "hot", "one source"):
        assert sum(want.values()) == pytest.approx(sum(sizes.values()))
        for name, target in want.items():
            fraction = target / sizes[name] % 1
            spread = sum(r["size"] ** 2 for r in got if source[r["doc_id"]] == name) * fraction * (1 - fraction)
            assert abs(taken[name] - target) <= 4 * spread**0.5 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.op9_mixing(spark, folder).collect()))
    mixed = mixing.mix_sources(table(spark, data))
    assert mixed.columns == table(spark, data).columns
    assert mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_rows_without_keys_toss_their_own_coins(spark):
    data = [(None, f"w{i} x", "en", "a", 1, 1, "") for i in range(400)] + [(i, "y " * 20, "en", "b", 1, 1, "") for i in range(40)]
    rows_ = mixing.with_copies(table(spark, data)).where("doc_id IS NULL").collect()
    rate = rows_[0]["__target"] / rows_[0]["__source_size"]
    assert 0.05 < rate % 1 < 0.95 and abs(sum(r["__copies"] for r in rows_) / 400 - rate) < 0.12


def test_special_tokens_in_texts(spark, tmp_path):
    texts = ["a  <|endoftext|>b c", "x <|endoftext|> y<|endoftext|>", " <|endoftext|>", "w " * 50 + "<|endoftext|>  \n z"]
    tok = Tokenizer.from_file(BPE)
    path = str(tmp_path / "codes")
    tokens.encode_tokens(table(spark, [(i, t, "", "", 1, 1, "") for i, t in enumerate(texts)]), path, BPE)
    back = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, path).collect()}
    assert all(back[i] == [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts))
