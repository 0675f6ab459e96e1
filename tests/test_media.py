"""Headers of written files, whole and broken."""

import io
import struct
import wave

import numpy as np
import pandas as pd
import pytest

from quillwave.sources import media as M


def read_of(data):
    return lambda at, n: data[at : at + n]


def wav(frames=100, rate=8000, channels=2, before=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0" * (2 * channels * frames))
    data = out.getvalue()
    return data[:12] + before + data[12:]


def aiff(frames=441, rate=44100):
    comm = struct.pack(">hIh", 1, frames, 24) + struct.pack(">HQ", 16383 + 15, rate << 48)
    return b"FORM" + struct.pack(">I", 4 + 8 + len(comm)) + b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm


def flac(frames=48000, rate=48000, channels=2, bits=24):
    word = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | frames
    return b"fLaC" + bytes([0, 0, 0, 34]) + b"\0" * 10 + word.to_bytes(8, "big") + b"\0" * 16


def test_formats():
    for data, want in (
        (wav(), ("wav", 8000.0, 2, 16, 100)), (wav(before=b"LIST" + struct.pack("<I", 3) + b"abc\0"), ("wav", 8000.0, 2, 16, 100)),
        (aiff(), ("aiff", 44100.0, 1, 24, 441)), (flac(), ("flac", 48000.0, 2, 24, 48000)),
    ):
        assert M.header(read_of(data), len(data)) == want


@pytest.mark.parametrize("data,why", [
    (b"", "empty"), (b"RIFF", "unknown format"), (b"ID3" * 40, "unknown format"), (wav()[:60], "truncated"), (wav()[:30], "truncated"), (wav()[:12], "no format"), (wav()[:36], "no samples"),
    (wav()[:22] + b"\0\0" + wav()[24:], "bad format"), (aiff()[:30], "truncated"), (flac()[:30], "truncated"), (flac(rate=0), "bad format"),
])
def test_broken(data, why):
    with pytest.raises(M.Broken, match=why):
        M.header(read_of(data), len(data))


def test_scan_of_written_files(spark, tmp_path):
    r = np.random.default_rng(1)
    n = 250
    signal = pd.concat([pd.DataFrame({"series_id": "a b%41", "channel": c, "pos": np.arange(n), "value": r.uniform(-1.2, 1.2, n)}) for c in (0, 1)])
    signal.loc[signal["pos"] == 7, "value"] = None
    from pyspark.sql import functions as F

    files = M.wave_files(spark.createDataFrame(signal), 100, 100)
    folder = str(tmp_path / "in here")
    name = F.concat("series_id", F.lit("-"), "part", F.lit(".wav"))
    assert M.write_files(files, name, F.col("content"), folder) == 3 == M.write_files(files, name, F.col("content"), folder)
    (tmp_path / "in here" / "sub").mkdir()
    (tmp_path / "in here" / "sub" / "x.wav").write_bytes(wav()[:60])
    got = M.scan_media(spark, folder)
    good, bad = M.split_media(got)
    assert sorted((r.path.rsplit("/")[-1], r.format, r.rate_hz, r.channels, r.bits, r.frames, r.seconds) for r in good.collect()) == [(f"a b%41-{i}.wav", "wav", 100.0, 2, 16, m, m / 100) for i, m in enumerate((100, 100, 50))]
    assert [(r.path.rsplit("/")[-1], r.error) for r in bad.collect()] == [("x.wav", "truncated")]
    with wave.open(f"{folder}/a b%41-2.wav") as w:  # read back by another reader
        x = np.frombuffer(w.readframes(50), "<i2").reshape(-1, 2)
    assert np.abs(x[:, 1] / 32767 - np.clip(signal[signal.channel == 1].value.to_numpy()[200:], -1, 1)).max() < 1e-4
    assert M.scan_media(spark, str(tmp_path / "absent")).count() == 0
    assert M.write_files(files.limit(0), name, F.col("content"), folder) == 0
