import hashlib
import struct
import time
import zlib

import numpy as np
import pytest

from sparkloom.llm import media

from .helpers import documents_dir, rows, table


@pytest.mark.parametrize("share", [0.02, 0.15, 0.6, 1.0])
def test_any_coefficients_survive_all_kinds_of_scans(share):
    rng = np.random.default_rng(int(share * 100))
    coefs = rng.integers(-200, 200, (150, 64)) * (rng.random((150, 64)) < share)
    out = np.zeros_like(coefs)
    for start, stop, high, low in ((0, 0, 0, 1), (0, 0, 1, 0), (1, 20, 0, 2), (21, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)):
        data, stops = media.packed_scan(coefs, start, stop, high, low)
        args = media.Bits(data), np.append(0, stops[:-1]) * 8, np.arange(len(coefs)), np.ones(len(coefs), np.int64), out
        if stop == 0:
            media.scan_dc(*args, high, low, media.DC)
        elif high:
            media.scan_refine(*args, start, stop, low, media.AC)
        else:
            media.scan_ac(*args, start, stop, low, media.AC)
    assert (out == coefs).all()


def test_inverse_transform_and_colours():
    coefs = np.zeros(64)
    coefs[0] = 80  # a flat block
    assert ((coefs @ media.INVERSE) / 4096 == pytest.approx(10, abs=0.01))
    rng = np.random.default_rng(0)
    block = rng.normal(0, 20, 64)
    x, u = np.arange(8), np.arange(8)
    wave = np.cos((2 * x[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    natural = np.zeros(64)
    natural[media.ZIGZAG] = block
    assert np.abs(wave @ natural.reshape(8, 8) @ wave.T - (block @ media.INVERSE / 4096).reshape(8, 8)).max() < 0.1
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_wide_images_and_restarts():
    payload = bytes(range(256)) * 64 * 3
    [(back, rgb)] = media.decode_images(media.encode_images([payload]))
    assert back == payload and rgb.shape[2] == 3 and rgb.dtype == np.uint8
    image = media.encode_images([media.padded(b"")])[0]
    assert image[:2] == b"\xff\xd8" and image[-2:] == b"\xff\xd9" and image.count(b"\xff\xda") == 15


def test_op5_round_trip(spark, tmp_path):
    data = rows()
    got = media.op5_media(spark, documents_dir(table(spark, data), tmp_path)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()), len(p := media.padded((r[1] or "").encode())), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in data), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    by_text: dict = {}
    for r in got:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    again = {hashlib.sha256(r["rgb"]).hexdigest(): (r["height"], r["width"]) for r in media.decoded_media(media.with_media(table(spark, data))).select("height", "width", "rgb").collect()}
    assert all(again[r["rgb_sha256"]] == (r["height"], r["width"]) and r["rgb_bytes"] == r["height"] * r["width"] * 3 for r in got)
    full = media.decoded_media(media.with_media(table(spark, data))).select("height", "width", "rgb").first()
    assert len(full["rgb"]) == full["height"] * full["width"] * 3
    assert media.decoded_media(media.with_media(table(spark, []))).count() == 0


def prose(n: int) -> list[bytes]:
    """Payloads like lower-case prose of some 3 KB."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"etaoinshrdlucmfwypvbgk      ,.ETA", np.uint8)
    return [media.padded(rng.choice(letters, int(k)).tobytes()) for k in rng.integers(1000, 5000, n)]


def test_images_cost_a_few_times_what_deflate_costs():
    payloads = prose(400)

    def there_and_back():
        for _, rgb in media.decode_images(media.encode_images(payloads)):
            media.channel_sums(rgb)

    def deflated():
        for p in payloads * 4:
            zlib.compress(p, 6)

    took = {there_and_back: [], deflated: []}
    for _ in range(5):
        for work, seconds in took.items():
            begin = time.thread_time()
            work()
            seconds.append(time.thread_time() - begin)
    assert min(took[there_and_back]) < 3.2 * min(took[deflated])  # it was 5 times


def test_images_are_the_same_bytes_as_ever():
    images = media.encode_images(prose(5) + [bytes(range(256)) * 3, media.padded(b"")])
    assert hashlib.sha256(b"".join(images)).hexdigest() == "76eb2c4a0ca0edb26373d444dd0db6582cd23cd882e5279de7e01a58db5c4f6d"
    back = [(p, rgb.shape, rgb.tobytes()) for p, rgb in media.decode_images(images)]
    assert hashlib.sha256(repr(back).encode()).hexdigest() == "32cc898bdec8efc25b74786f9e1bc705ca05cae0a545b1c00419756570295e01"


def test_bit_strings_against_text():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 57, 500)
    values = np.array([int(rng.integers(0, 1 << 56)) >> (56 - n) for n in lengths.tolist()])
    block = np.sort(rng.integers(0, 60, 500))
    data, stops = media.packed(values, lengths, block, 62)
    begins = np.append(0, stops[:-1])
    for i in range(62):
        text = "".join(f"{v:0{n}b}" for v, n, b in zip(values.tolist(), lengths.tolist(), block.tolist(), strict=True) if b == i)
        text += "1" * (-len(text) % 8)
        assert "".join(f"{x:08b}" for x in data[begins[i] : stops[i]].tolist()) == text
    full = np.where(rng.random(len(data)) < 0.3, 255, data).astype(np.uint8)
    restart = np.where(np.arange(62) % 9 == 4, -1, np.arange(62) % 8)
    got, ends = media.stuffed(full, stops, restart)
    want = [full[a:b].tobytes().replace(b"\xff", b"\xff\x00") + (bytes([255, 0xD0 + r]) if r >= 0 else b"") for a, b, r in zip(begins, stops, restart.tolist(), strict=True)]
    assert got.tobytes() == b"".join(want) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


@pytest.mark.parametrize("most", [100, 255, 600])
def test_bands_that_are_dense_at_first(most):
    rng = np.random.default_rng(most)
    coefs = rng.integers(1, most + 1, (90, 64))
    coefs[40:, 30:] = 0
    coefs[70:, 50:] = -rng.integers(1, most + 1, (20, 14))
    for some in (coefs, coefs[:40]):
        out = np.zeros_like(some)
        data, stops = media.packed_scan(some, 1, 63, 0, 0)
        media.scan_ac(media.Bits(data), np.append(0, stops[:-1]) * 8, np.arange(len(some)), np.ones(len(some), np.int64), out, 1, 63, 0, media.AC)
        assert (out[:, 1:] == some[:, 1:]).all()


def test_restart_intervals_of_several_blocks():
    rng = np.random.default_rng(4)
    coefs = rng.integers(-90, 90, (20, 64)) * (rng.random((20, 64)) < 0.5)
    number = np.arange(20)
    interval, restart = number // 3, np.append(np.arange(6) % 8, -1)
    first = coefs.copy()
    first[number % 3 > 0, 0] -= coefs[:-1, 0][number[1:] % 3 > 0]
    scans = []
    for start, stop, strings in ((0, 0, media.dc_bits(first, 0, 0)), (1, 63, media.ac_bits(coefs, 1, 63, 0, 0))):
        value, length, block = strings
        data, _ = media.stuffed(*media.packed(value, length, interval[block], 7), restart)
        scans.append(media._segment(0xDA, bytes([1, 1, 0, start, stop, 0])) + data.tobytes())
    frame = struct.pack(">BHHB", 8, 32, 40, 1) + bytes([1, 0x11, 0])
    image = b"\xff\xd8" + media._segment(0xDB, bytes(1) + bytes([1] * 64)) + media._segment(0xC2, frame) + media._segment(0xC4, b"\x00" + media.DC[0]) + media._segment(0xC4, b"\x10" + media.AC[0]) + media._segment(0xDD, struct.pack(">H", 3)) + b"".join(scans) + b"\xff\xd9"
    found, got, begins = media.decode_coefficients([image, image])
    assert (got == np.concatenate([coefs, coefs])).all() and begins.tolist() == [0, 20, 40]
    assert [rgb.shape for _, rgb in media.decode_images([image])] == [(32, 40, 3)]


def test_squares_against_planes(monkeypatch):
    monkeypatch.setattr(media, "WIDEST", 4)
    rng = np.random.default_rng(6)
    images = media.encode_images([rng.integers(0, 256, 64 * n, np.uint8).tobytes() for n in (1, 6, 25, 100)])
    found, coefs, begins = media.decode_coefficients(images)
    wave = coefs @ media.INVERSE
    samples = media.samples_of(coefs)
    assert (samples == np.clip(np.floor((wave + 2048) / 4096) + 128, 0, 255)).all()
    assert (media.samples_of(coefs.astype(np.int64) * 99) == np.clip(np.floor((wave * 99 + 2048) / 4096) + 128, 0, 255)).all()
    for (_, rgb), image, a, b in zip(media.decode_images(images), found, begins[:-1], begins[1:], strict=True):
        assert (rgb == media.rgb_of(image, samples[a:b])).all()
        pixels = rgb.reshape(-1, 3).astype(np.int64)
        assert [x.tolist() for x in media.channel_sums(rgb)] == [pixels.sum(axis=0).tolist(), (pixels**2).sum(axis=0).tolist()]
    assert found[-1].height == 80 and list(media.decode_images([])) == []
