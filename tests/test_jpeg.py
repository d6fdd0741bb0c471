"""JPEG files: what Spark's reader makes of them, their code tables and symbols against plain versions, and build with --jpeg."""

import struct

import numpy as np
import pytest
from test_build import png
from test_transfer import server  # noqa: F401

from pairmend.__main__ import main
from pairmend.sources import images, jpeg


def picture(kind, height, width):
    y, x = np.mgrid[:height, :width]
    if kind == "smooth":
        return np.clip(np.stack([128 + 100 * np.sin(x / 17 + y / 31), 128 + 100 * np.cos(x / 23 - y / 13), 128 + 90 * np.sin(x / 40)], 2), 0, 255).astype(np.uint8)
    if kind == "grey noise":
        return np.repeat(np.random.default_rng(0).integers(0, 256, (height, width, 1)), 3, 2).astype(np.uint8)
    return np.full((height, width, 3), (200, 40, 60), np.uint8)


def test_readers_see_the_picture(spark, tmp_path):
    sizes = ((1, 1), (1, 40), (7, 9), (16, 16), (17, 33), (301, 257), (700, 900))
    made = {f"{kind}-{h}-{w}.jpg": (kind, picture(kind, h, w)) for kind in ("smooth", "grey noise", "flat") for h, w in sizes}
    for name, (_, pixels) in made.items():
        (tmp_path / name.replace(" ", "_")).write_bytes(jpeg.encode(pixels))
    got = {r["origin"].rsplit("/", 1)[-1].replace("_", " "): r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got.keys() == made.keys()
    for name, (kind, pixels) in made.items():
        r = got[name]
        assert r["ok"] and (r["height"], r["width"], r["channels"]) == pixels.shape, name
        seen = np.frombuffer(bytes(r["data"]), np.uint8).reshape(pixels.shape)[:, :, ::-1]
        off = ((seen.astype(float) - pixels) ** 2).mean()
        assert 10 * np.log10(255**2 / max(off, 1e-9)) > (36 if kind == "grey noise" else 42), (name, off)


def test_quality_sets_size_and_steps():
    pixels = picture("smooth", 200, 200)
    sizes = [len(jpeg.encode(pixels, q)) for q in (1, 10, 50, 75, 92, 100)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1] / 5
    assert jpeg.steps(jpeg.BRIGHTNESS, 92)[:8].tolist() == [3, 2, 2, 3, 4, 6, 8, 10] and set(jpeg.steps(jpeg.COLOUR, 100)) == {1}
    assert jpeg.encode(picture("grey noise", 64, 64), 100)[-2:] == b"\xff\xd9"


def test_what_has_no_picture():
    assert jpeg.of_image(None, 1, 1, 3) is None and jpeg.of_image(b"", -1, -1, -1) is None and jpeg.of_image(b"", 0, 4, 3) is None
    assert jpeg.of_image(b"", None, None, None) is None and jpeg.of_image(b"", 1, 65536, 3) is None
    grey, alpha = jpeg.of_image(bytes([90] * 4), 2, 2, 1), jpeg.of_image(bytes([90, 90, 90, 7] * 4), 2, 2, 4)
    assert grey == alpha == jpeg.encode(np.full((2, 2, 3), 90, np.uint8))
    assert struct.unpack(">HH", grey[grey.index(b"\xff\xc0") + 5 :][:4]) == (2, 2)


@pytest.mark.parametrize("counts", [[1], [5, 0, 5], [2**k for k in range(40)], [1, 1] + [2] * 254, [1] * 256, [10**9] + [1] * 255])
def test_code_tables_fit(counts):
    """No code is longer than 16 bits or of ones alone, each starts none, and rarer symbols have no shorter codes."""
    lengths, symbols = jpeg.code_table(np.array(counts + [0] * (256 - len(counts))))
    assert sorted(symbols) == [s for s, n in enumerate(counts) if n] and sum(lengths) == len(symbols) and len(lengths) == 16
    assert sum(n / 2**size for size, n in enumerate(lengths, 1)) < 1
    codes, sizes = jpeg._codes(lengths, symbols)
    texts = [format(codes[s], f"0{sizes[s]}b") for s in symbols]
    assert all("0" in t for t in texts) and not any(b.startswith(a) for a, b in zip(sorted(texts), sorted(texts)[1:], strict=False))
    assert all(counts[a] >= counts[b] for a in symbols for b in symbols if sizes[a] < sizes[b])


def test_symbols_are_the_plain_ones():
    rng = np.random.default_rng(3)
    blocks = (rng.integers(-1000, 1000, (60, 64)) * (rng.random((60, 64)) < rng.choice([0.02, 0.3, 1.0], (60, 1)))).astype(np.int16)
    blocks[7, 1:], blocks[8, 1:63], blocks[8, 63] = 0, 0, -1
    plain = []
    for i, block in enumerate(blocks.tolist()):
        colour, zeros = int(i % 6 >= 4), 0
        size = abs(block[0]).bit_length()
        plain.append((colour, size, block[0] if block[0] >= 0 else block[0] + 2**size - 1, size))
        for v in block[1:]:
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                plain.append((2 + colour, 0xF0, 0, 0))
                zeros -= 16
            size = abs(v).bit_length()
            plain.append((2 + colour, zeros * 16 + size, v if v >= 0 else v + 2**size - 1, size))
            zeros = 0
        if zeros:
            plain.append((2 + colour, 0, 0, 0))
    assert [tuple(int(x) for x in t) for t in zip(*jpeg._tokens(blocks), strict=True)] == plain


def test_build_writes_jpeg(spark, tmp_path, server):  # noqa: F811
    """Local and fetched images, whatever they were, become JPEG in their places; a broken one is missing, and nothing is left aside."""
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "1.png").write_bytes(png((200, 40, 60)))
    (tmp_path / "img" / "2.png").write_bytes(b"no image")
    root = tmp_path / "root"
    raw = "row_id,title,category,attributes_json,image_path,image_url\n"
    (tmp_path / "raw.csv").write_text(raw + f"1,a,c,{{}},1.png,\n2,b,c,{{}},2.png,\n3,d,c,{{}},3.png,\n4,e,c,{{}},,{server[0]}/ok\n5,f,c,{{}},,\n6,g,c,{{}},1.png,\n")
    main(["build", str(tmp_path / "raw.csv"), str(tmp_path / "rows.parquet"), "--images", str(tmp_path / "img"), "--root", str(root), "--fetch", "--jpeg"], spark)
    rows = {r["row_id"]: r for r in spark.read.parquet(str(tmp_path / "rows.parquet")).collect()}
    assert {k: r["is_image_missing"] for k, r in rows.items()} == {"1": False, "2": True, "3": True, "4": False, "5": True, "6": False}
    there = sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert there == sorted(rows[k]["image_path"] for k in "146")
    assert all((root / x).read_bytes()[:2] == b"\xff\xd8" for x in there)
    seen = {r["origin"].rsplit("/", 1)[-1]: r for r in images.dominant_colors(images.read_images(spark, str(root))).collect()}
    assert seen["1.jpg"]["img_color"] == seen["6.jpg"]["img_color"] == "red" and seen["4.jpg"]["img_color"] == "blue"
