"""Media columns: GIF.

``decode`` reads any GIF87a/89a stream: LZW codes of growing width with clear and end
codes, global and local palettes, interlacing, transparency and the disposal methods
(leave, background, previous).  Frames come with their delay and a histogram of 64 colours
(two bits a channel) of the composited canvas.  ``encode`` writes frames of 8-bit samples
losslessly, compressed with a table of up to 4096 strings.  The width of a code follows from
its place after the last clear code, so codes are packed and unpacked as arrays.

Defined results: null media has no frames; null text is stored as 64 zero bytes; a text of
more than ``MOST_ROWS`` rows has several frames; equal texts give equal media; an empty table
gives no rows; other columns of the media table pass through, but one named ``frames`` is
replaced; a stream that is no GIF or ends early raises ValueError.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import blocks, lean

WIDTH = 64
MOST_ROWS = 65535
#: Width of the longest LZW codes.
MOST_BITS = 12
OPAQUE = np.uint32(0xFF000000)

FRAME = "struct<frame:int,delay_ms:int,left:int,top:int,width:int,height:int,samples:binary,histogram:array<int>>"
_frame_type = pa.struct(
    [("frame", pa.int32()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int32()))]
)


def colours() -> np.ndarray:
    """256 different colours: three bits of red and green and two of blue of the sample."""
    i = np.arange(256)
    return np.stack((i & 0xE0, (i << 3) & 0xE0, (i << 6) & 0xC0), axis=1).astype(np.uint8)


@functools.cache
def _schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and place in bits of every code after a clear code: the reader adds a string with each code but the first."""
    full = 1 << MOST_BITS
    strings = np.minimum((1 << size) + 1 + np.maximum(np.arange(full), 1), full - 1)
    widths = np.maximum(size + 1, np.floor(np.log2(strings)).astype(np.int64) + 1)
    return widths, np.cumsum(widths) - widths


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most 12 bits, least significant bit first."""
    stops = np.cumsum(widths)
    at = stops - widths
    value = codes << (at & 7)
    out = np.zeros((int(stops[-1]) + 7) // 8 + 2, np.int64)
    for k in range(3):
        # A byte's parts come from different bits, so their sum is their union.
        out += np.bincount((at >> 3) + k, weights=value >> 8 * k & 255, minlength=len(out)).astype(np.int64)
    return out[:-2].astype(np.uint8).tobytes()


def _unpack(padded: np.ndarray, bit: int, widths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Codes of these widths and places after ``bit``, as many as there are; padded has three more bytes than it holds codes."""
    n = int(np.searchsorted(places + widths, 8 * (len(padded) - 3) - bit, "right"))
    at = places[:n] + bit
    byte = at >> 3
    value = padded[byte].astype(np.int64) | padded[byte + 1].astype(np.int64) << 8 | padded[byte + 2].astype(np.int64) << 16
    return value >> (at & 7) & (1 << widths[:n]) - 1


def _runs(samples: bytes, size: int) -> Iterator[list[int]]:
    """Codes of samples, a list for each filling of the string table."""
    rest = iter(samples)
    own = next(rest, None)
    while own is not None:
        out: list[int] = []
        table: dict[int, int] = {}
        find, put, following = table.get, out.append, (1 << size) + 2
        for byte in rest:
            longer = find(own << 8 | byte)
            if longer is not None:
                own = longer
                continue
            put(own)
            if following == (1 << MOST_BITS) - 1:
                own = byte
                break
            table[own << 8 | byte] = following
            following += 1
            own = byte
        else:
            put(own)
            own = None
        yield out


def lzw_compress(samples: bytes, size: int = 8) -> bytes:
    """Codes for samples below ``2 ** size``, with a string table that is cleared when it is full."""
    schedule, _ = _schedule(size)
    codes, widths = [[1 << size]], [schedule[:1]]
    for run in _runs(samples, size):
        codes.append([*run, 1 << size])
        widths.append(schedule[: len(run) + 1])
    # The last run ends in the end code.
    codes[-1][-1] += len(codes) > 1
    flat = np.concatenate(codes) if len(codes) > 1 else np.array([1 << size, (1 << size) + 1])
    return _pack(flat, np.concatenate(widths) if len(codes) > 1 else np.repeat(schedule[:1], 2))


def lzw_decode(raw: np.ndarray, size: int, count: int) -> np.ndarray:
    """The first ``count`` samples of a code stream: the codes between two clear codes are unpacked at once, then looked up."""
    clear, end, full = 1 << size, (1 << size) + 1, 1 << MOST_BITS
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    padded = np.concatenate((raw, np.zeros(3, np.uint8)))
    out: list[bytes] = []
    total, bit, ended = 0, 0, False
    while total < count and not ended:
        widths, places = _schedule(size)
        read: list[int] = []
        while True:
            codes = _unpack(padded, bit, widths, places)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            used = int(stop[0]) if len(stop) else len(codes)
            read += codes[:used].tolist()
            if len(stop):
                bit += int(places[used] + widths[used])
                ended = int(codes[used]) == end
                break
            if used < full:
                ended = True
                break
            # A full table may be used on and on.
            bit += int(places[-1] + widths[-1])
            widths, places = np.full(full, MOST_BITS), np.arange(full) * MOST_BITS
        table = list(roots)
        add, put = table.append, out.append
        before = b""
        for code in read:
            if code < len(table):
                own = table[code]
            elif code == len(table) and before:
                own = before + before[:1]
            else:
                raise ValueError("a code beyond the table")
            if before and len(table) < full:
                add(before + own[:1])
            put(own)
            total += len(own)
            before = own
    if total < count:
        raise ValueError("image data ends early")
    return np.frombuffer(b"".join(out), np.uint8)[:count]


def _sub_blocks(raw: bytes) -> bytes:
    n = len(raw)
    full = n // 255
    grid = np.empty((full, 256), np.uint8)
    grid[:, 0] = 255
    grid[:, 1:] = np.frombuffer(raw, np.uint8, full * 255).reshape(full, 255)
    rest = raw[full * 255 :]
    return grid.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _read_blocks(data: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """Bytes of a chain of sub-blocks and the place after it."""
    lengths = data[at::256]
    full = int(np.argmin(lengths == 255)) if not (lengths == 255).all() else len(lengths)
    full = min(full, (len(data) - at) // 256)
    parts = [data[at : at + 256 * full].reshape(full, 256)[:, 1:].reshape(-1)]
    at += 256 * full
    while True:
        if at >= len(data):
            raise ValueError("a chain of blocks ends early")
        n = int(data[at])
        if not n:
            break
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return np.concatenate(parts), at + 1


def encode(frames: list[tuple[np.ndarray, int]], palette: np.ndarray | None = None) -> bytes:
    """A GIF89a of (rows x columns samples, delay in milliseconds) frames at the origin."""
    palette = colours() if palette is None else palette
    height, width = max(f.shape[0] for f, _ in frames), max(f.shape[1] for f, _ in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for samples, delay in frames:
        raw = lzw_compress(np.ascontiguousarray(samples).tobytes())
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, delay // 10, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, samples.shape[1], samples.shape[0], 0), b"\x08", _sub_blocks(raw)]
    return b"".join(out) + b"\x3b"


def _histogram(canvas: np.ndarray) -> list[int]:
    """Counts of 64 colours (two bits a channel) of what is opaque."""
    seen = canvas[canvas >= OPAQUE]
    return np.bincount((seen >> 2 & 0x30 | seen >> 12 & 0xC | seen >> 22 & 3).astype(np.int64), minlength=64).tolist()


def _colours_of(palette: np.ndarray) -> np.ndarray:
    """A palette as 256 opaque RGBA values (red lowest); samples beyond it have its last colour."""
    rgb = palette[np.minimum(np.arange(256), len(palette) - 1)].astype(np.uint32)
    return rgb[:, 0] | rgb[:, 1] << np.uint32(8) | rgb[:, 2] << np.uint32(16) | OPAQUE


def _rows_in_order(h: int) -> np.ndarray:
    """The row that each stored row of an interlaced frame belongs to."""
    return np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(raw: bytes, pixels: bool = False) -> list[dict]:
    """Frames of a GIF; with ``pixels`` also the composited canvas (rows x columns x RGBA) of each."""
    data = np.frombuffer(raw, np.uint8)
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    at, everywhere = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        everywhere = data[at : at + 3 * n].reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, clear_index = 0, 0, -1
    out: list[dict] = []
    undo: tuple | None = None
    while at < len(raw):
        kind = raw[at]
        if kind == 0x3B:
            return out
        if kind == 0x21:
            body, after = _read_blocks(data, at + 2)
            if raw[at + 1] == 0xF9 and len(body) >= 4:
                disposal = int(body[0]) >> 2 & 7
                clear_index = int(body[3]) if body[0] & 1 else -1
                delay = (int(body[1]) | int(body[2]) << 8) * 10
            at = after
            continue
        if kind != 0x2C or at + 11 > len(raw):
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        palette = everywhere
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = data[at : at + 3 * n].reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        size = raw[at]
        codes, at = _read_blocks(data, at + 1)
        grid = lzw_decode(codes, size, w * h).reshape(h, w)
        if flags & 0x40:
            grid = grid[np.argsort(_rows_in_order(h))]
        if undo is not None:
            y, x, part = undo
            canvas[y : y + part.shape[0], x : x + part.shape[1]] = part
        area = canvas[top : top + h, left : left + w]
        undo = (top, left, area.copy() if disposal == 3 else np.zeros_like(area)) if disposal in (2, 3) else None
        shown = grid[: area.shape[0], : area.shape[1]]
        colour = _colours_of(palette)[shown]
        area[:] = colour if clear_index < 0 else np.where(shown == clear_index, area, colour)
        made = {"frame": len(out), "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "samples": grid.tobytes(), "histogram": _histogram(canvas)}
        if pixels:
            made["pixels"] = canvas.view(np.uint8).reshape(height, width, 4).copy()
        out.append(made)
        delay, disposal, clear_index = 0, 0, -1
    raise ValueError("no trailer")


def text_frames(text: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """A text's bytes, padded by zeros to a positive multiple of WIDTH, as frames of WIDTH columns."""
    rows = max(1, -(-len(text) // WIDTH))
    padded = np.zeros(rows * WIDTH, np.uint8)
    padded[: len(text)] = text
    grid = padded.reshape(rows, WIDTH)
    return [(grid[i : i + MOST_ROWS], 40) for i in range(0, rows, MOST_ROWS)]


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                places = offsets.tolist()
                media = [encode(text_frames(data[i:j])) for i, j in zip(places, places[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def read_frames(stored: DataFrame, column: str = "media") -> DataFrame:
    """Add ``frames`` (array of FRAME) read from a binary column of GIF streams; a clashing column is replaced."""
    kept = [c for c in stored.columns if c != "frames"]
    stored = stored.select(*kept)
    at = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(at)):
                part = batch.slice(a, b - a)
                made = [decode(m) if m is not None else [] for m in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(_frame_type))], names=[*kept, "frames"])

    return stored.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema) + f", frames array<{FRAME}>")


def digests(docs: DataFrame) -> DataFrame:
    """The op5 row of every document, from the media that store_texts made and read_frames read."""
    read = read_frames(store_texts(docs))
    payload = read.select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(frames, cast('' as binary), (x, f) -> concat(x, f.samples))").alias("payload"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.expr("concat_ws('|', transform(frames, f -> concat(f.width, 'x', f.height, '@', f.delay_ms, ':', concat_ws(',', transform(f.histogram, n -> cast(n as string))))))").alias("feature"),
    )
    return payload.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
