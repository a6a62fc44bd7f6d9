import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import media
from tidemark.llm import progressive_jpeg as jpeg


def odd_coefficients():
    rng = np.random.default_rng(0)
    c = rng.integers(-128, 128, (14, 6, 64))
    c[2], c[3, :, 20:], c[7], c[8] = 0, 0, -1, 1
    c[4] = rng.choice([0, 0, 0, 0, 1, -1, 5], (6, 64))
    c[5, :, 10:50], c[5, :, 55] = 0, 1
    c[6] = rng.choice([0] * 40 + [1, -1, 2], (6, 64))
    return np.array([1, 3, 2, 8]), c


def test_round_trip_of_coefficients():
    mcus, values = odd_coefficients()
    images = [jpeg.parse(f)[0] for f in jpeg.encode(values, mcus, [b"x"] * 4)]
    for together in (images, [images[2]], [images[3]]):
        for image, got in zip(together, jpeg.decode_coefficients(together)):
            n = images.index(image)
            own = values[mcus[:n].sum() : mcus[: n + 1].sum()]
            assert (got[0] == own[:, :4].reshape(-1, 64)).all() and (got[1] == own[:, 4]).all() and (got[2] == own[:, 5]).all()


def test_without_restart_intervals_and_with_runs_of_blocks():
    """A hand-made greyscale picture: one lane a scan, and an end-of-band run over all its blocks."""
    blocks = 6
    bits = "".join(f"{jpeg.DC_CODES[4][0]:04b}" + "1000" if n == 0 else f"{jpeg.DC_CODES[0][0]:04b}" for n in range(blocks))
    dc = bits + "1" * (-len(bits) % 8)
    code, length = jpeg.AC_CODES[2 << 4]  # a run of 4 + 2 blocks
    ac = f"{code:0{length}b}" + "10"
    ac += "1" * (-len(ac) % 8)
    pack = lambda b: bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")
    data = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([8] + [1] * 63)) + jpeg.segment(0xC4, b"\0" + jpeg.DC_TABLE + b"\x10" + jpeg.AC_TABLE)
    data += jpeg.segment(0xC2, bytes([8, 0, 9, 0, 20, 1, 1, 0x11, 0])) + jpeg.segment(0xDA, bytes([1, 1, 0, 0, 0, 0])) + pack(dc)
    data += jpeg.segment(0xDA, bytes([1, 1, 0, 1, 63, 0])) + pack(ac) + b"\xff\xd9"
    (image,) = jpeg.parse(data)
    coefficients = jpeg.decode_coefficients([image])
    assert coefficients[0][0][:, 0].tolist() == [8] * blocks and not coefficients[0][0][:, 1:].any()
    (rgb,) = jpeg.to_rgb([image], coefficients)
    assert rgb.shape == (9, 20, 3) and (rgb == 136).all()


def test_inverse_transform_and_colours():
    rng = np.random.default_rng(1)
    values = np.zeros((2, 6, 64), dtype=np.int64)
    values[:, :, :12] = rng.integers(-100, 100, (2, 6, 12))
    image = jpeg.parse(jpeg.encode(values, np.array([2]), [b""])[0])[0]
    (rgb,) = jpeg.to_rgb([image], jpeg.decode_coefficients([image]))
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)

    def block(z):
        freq = np.zeros(64)
        freq[jpeg.ZIGZAG] = z
        return np.clip(np.round(basis @ freq.reshape(8, 8) @ basis.T) + 128, 0, 255)

    want = []
    for mcu in values:
        y = np.block([[block(mcu[0]), block(mcu[1])], [block(mcu[2]), block(mcu[3])]])
        cb, cr = (np.kron(block(mcu[c]), np.ones((2, 2))) - 128 for c in (4, 5))
        want.append(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=-1))
    assert np.abs(np.clip(np.concatenate(want), 0, 255) - rgb).max() <= 2.5


def test_media_columns(spark):
    texts = ["abc", None, "", "é" * 288, "x" * 576, "x" * 577, "long \x80\x81\0 " * 80_000, "中文字符" * 200, "abc"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, width int")
    rows = media.read_media(media.add_media(frame)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = media.payload(texts[r.doc_id])
        assert r.payload == want and r.n_bytes == len((texts[r.doc_id] or "").encode()) and len(want) % 576 == 0 < len(want)
        assert len(r.rgb) == r.width * r.height * 3
    by = {r.doc_id: r for r in rows}
    assert by[0].media == by[8].media and by[0].feature == by[8].feature and by[1].media == by[2].media
    alone = media.read_media(media.add_media(frame.filter("doc_id = 3")), rgb=False).first()
    assert (alone.media, alone.feature) == (by[3].media, by[3].feature)
    assert media.read_media(media.add_media(frame.limit(0))).count() == 0
    none = media.read_media(media.add_media(frame).withColumn("media", F.when(F.col("doc_id") != 0, F.col("media"))))
    assert [r.payload is None for r in none.orderBy("doc_id").collect()] == [n == 0 for n in range(len(texts))]


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "hello"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in media.op4_progressive_jpeg(spark, str(tmp_path)).collect():
        want = media.payload({1: "hello"}.get(r.doc_id))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


def test_broken_streams_are_null_and_leave_others_alone(spark):
    good = media.to_media([media.payload("some text " * 400), media.payload("other")])
    rows = [(0, good[0]), (1, good[1])] + [(2 + n, good[0][:cut]) for n, cut in enumerate((3, 40, 200, 700, len(good[0]) // 2))] + [(9, b"no picture"), (10, None)]
    got = {r.id: r for r in media.read_media(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in rows], "id int, media binary")).collect()}
    assert bytes(got[0].payload) == media.payload("some text " * 400) and bytes(got[1].payload) == media.payload("other")
    assert len(got) == len(rows) and got[10].payload is None and got[9].payload is None
