"""Secret scan with a worklist of decoded layers.

Every whole text is searched for three kinds of secrets. Then runs that look
encoded (URL escapes, Unicode escapes, base64, and base64 of gzip or zlib
data) are decoded into layers of their own, which are searched and decoded in
turn until nothing new appears. A base64 run goes on over line ends, as far as
it decodes; its lines are tried alone as well. Bytes that are no text become
replacement characters, so they hide nothing around them; bytes that look like
UTF-16 are read as such. Each character of a layer knows the span of
the original text it came from, so a find in a nested layer is reported as a
span of the text. A layer that has been seen for the same span is not opened
again, which ends cycles. The work is row-local; there is no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # whole runs, as those that are too short drop out
WORDS = ("passw", "secret", "token", "apikey", "api_key")  # one of them is in every find of the first kind

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# The rest of a line end between two lines of one base64 run, and the line that follows.
# A line end may be written as an escape, as in JSON.
WRAP = re.compile(r"(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/_-]+={0,2})")
# The shortest find has 14 characters in a row; bytes without them are no layer.
READABLE = re.compile(rb"[\x09-\x0d\x20-\x7e]{14}")
WIDE = re.compile(rb"(?P<le>(?:[\x09-\x0d\x20-\x7e]\0){14})|(?:\0[\x09-\x0d\x20-\x7e]){14}")
#: Inflated data is scanned in blocks of so many bytes, each with the last
#: ``OVERLAP`` characters of the one before, so the memory of a run is bounded.
INFLATE_LIMIT = 64 << 20
OVERLAP = 1 << 20

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost matches of each kind that
    do not overlap, without those that are too short."""
    low, out = text.lower(), []
    if any(word in low for word in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Layer:
    """A text whose character i came from ``spans[i]`` of the original; a
    layer without spans is the original."""

    def __init__(self, text: str, spans: list[Span] | Whole | None, path: tuple[str, ...]):
        self.text, self.spans, self.path = text, spans, path

    @cached_property
    def shown(self) -> set[tuple[str, int, int]]:
        """Finds of the layer as it stands, as spans of the original."""
        return {(k, *self.origin(s, e)) for k, s, e in base_spans(self.text)}

    def origin(self, start: int, end: int) -> Span:
        if self.spans is None:
            return start, end
        return min(s for s, _ in self.spans[start:end]), max(e for _, e in self.spans[start:end])


def _wide(data: bytes) -> tuple[str, int] | None:
    """The kind of UTF-16 that some of the bytes look like, and the first
    byte (0 or 1) of its units."""
    m = WIDE.search(data)
    return m and ("utf-16-le" if m["le"] else "utf-16-be", m.start() % 2)


def _characters(data: bytes, spans: list[Span], wide: tuple[str, int] | None = None) -> tuple[str, list[Span]]:
    """Bytes with a span each, to characters with a span each. What is no
    UTF-8 or UTF-16 becomes a replacement character for each byte or unit."""
    if wide:
        spans = spans[wide[1]:]
        raw = data[wide[1]:(len(data) - wide[1]) // 2 * 2 + wide[1]].decode(wide[0], "surrogatepass")
        lengths = [4 if ord(c) > 0xFFFF else 2 for c in raw]
    else:
        raw = data.decode("utf-8", "surrogateescape")
        lengths = [1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode("utf-8")) for c in raw]
    out, at = [], 0
    for n in lengths:
        out.append((spans[at][0], spans[min(at + n, len(spans)) - 1][1]))
        at = min(at + n, len(spans) - 1)
    return re.sub("[\ud800-\udfff]", "\ufffd", raw), out


def _escapes(layer: Layer) -> Iterator[Layer]:
    """The layer with all URL escapes, and with all Unicode escapes, undone.
    The characters around stay, since a secret may be escaped in part."""
    for name, sign, pattern in (("url", "%", URL_RUN), ("unicode", "\\", UNICODE_RUN)):
        if sign not in layer.text:
            continue
        parts, spans, at, changed = [], [], 0, False
        for m in pattern.finditer(layer.text):
            new = _unescape(layer, m)
            changed = True
            parts += [layer.text[at:m.start()], new[0]]
            spans += [layer.origin(i, i + 1) for i in range(at, m.start())] + new[1]
            at = m.end()
        if changed:
            parts.append(layer.text[at:])
            spans += [layer.origin(i, i + 1) for i in range(at, len(layer.text))]
            yield Layer("".join(parts), spans, (*layer.path, name))


def _unescape(layer: Layer, m: re.Match) -> tuple[str, list[Span]]:
    run, width = m.group(), {"%": 3, "\\u": 6, "\\x": 4}["%" if m.group()[0] == "%" else m.group()[:2]]
    spans = [layer.origin(m.start() + k, m.start() + k + width) for k in range(0, len(run), width)]
    if width == 6:
        units = b"".join(int(run[k + 2:k + 6], 16).to_bytes(2, "big") for k in range(0, len(run), 6))
        text = units.decode("utf-16-be", "replace")
        out, at = [], 0
        for c in text:
            n = 2 if ord(c) > 0xFFFF else 1
            out.append((spans[at][0], spans[min(at + n, len(spans)) - 1][1]))
            at = min(at + n, len(spans) - 1)
        return text, out
    return _characters(bytes(int(run[k + width - 2:k + width], 16) for k in range(0, len(run), width)), spans)


class Whole:
    """The spans of a text all of which came from one span; ``later`` are the
    blocks of inflated data after the first."""

    def __init__(self, span: Span, later: bool):
        self.span, self.later = span, later

    def __getitem__(self, at: slice) -> list[Span]:
        return [self.span]


def _inflated(data: bytes) -> Iterator[str]:
    """Texts of gzip or zlib data, member after member, in blocks, with
    replacement characters for what is no text. A stream that breaks off or is
    damaged gives what could be read."""
    while _compressed(data):
        z, tail = zlib.decompressobj(47), ""  # either header
        decoder = None
        feed = data
        while True:
            plain, damaged = _plain(z, feed)
            if decoder is None:
                wide = None if READABLE.search(plain) else _wide(plain)
                decoder = codecs.getincrementaldecoder(wide[0] if wide else "utf-8")("replace")
                plain = plain[wide[1]:] if wide else plain
            text = decoder.decode(plain, z.eof or damaged)
            if text:
                yield tail + text
                tail = (tail + text)[-OVERLAP:]
            feed = z.unconsumed_tail
            if damaged or z.eof or not feed and not plain:
                break
        if not z.eof:
            return
        data = z.unused_data


def _plain(z, feed: bytes) -> tuple[bytes, bool]:
    """The next block, and whether the stream is damaged; of a damaged block
    what comes before the fault."""
    before = z.copy()
    try:
        return z.decompress(feed, INFLATE_LIMIT), False
    except zlib.error:
        pass
    out = bytearray()
    # halve the steps, so the bytes before the fault are found in few tries
    step, at = max(1, len(feed) // 2), 0
    while step:
        trial = before.copy()
        try:
            out += trial.decompress(feed[at:at + step], INFLATE_LIMIT - len(out))
            before, at = trial, at + step
            if at >= len(feed) or trial.unconsumed_tail:
                break
        except zlib.error:
            step //= 2
    return bytes(out), True


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _runs(text: str) -> Iterator[list[Span]]:
    """Base64 runs as spans of their lines: every run of a line alone, and
    the run with the lines after it that it may go on over."""
    ends, done = {}, 0  # of a chain's lines: the chain and the line's place in it; end of the last joined run
    for m in BASE64_RUN.finditer(text):
        yield [m.span()]
        chain, k = ends.get(m.start()) or ([m.span()], 0)
        if not k:
            end = m.end()
            while text[end - 1] != "=" and (n := WRAP.match(text, end)):
                chain.append(n.span(1))
                end = n.end()
            ends |= {s: (chain, j) for j, (s, _) in enumerate(chain) if j}
        if len(chain) - k > 1 and m.start() >= done and (last := _joined(text, chain, k)) > k:
            yield chain[k:last + 1]
            done = chain[last][1]


def _stream_line(text: str, chain: list[Span], first: int) -> int | None:
    """The line in which compressed data that starts with line ``first`` ends:
    that of its last member's end, of a fault after some output, or the last
    line. None if nothing can be read. Lines are read one after the other and no
    further than the data goes."""
    z, rest, pending, end, some = zlib.decompressobj(47), "", b"", None, False
    for k, (s, e) in enumerate(chain[first:], first):
        rest += text[s:e].rstrip("=")
        cut = len(rest) // 4 * 4 if k + 1 < len(chain) else len(rest) - (len(rest) % 4 == 1)
        pending += _decoded(rest[:cut]) or b""
        rest = rest[cut:]
        while pending:
            if z is None:
                if len(pending) < 2 and pending[:1] in (b"\x1f", b"\x78") and k + 1 < len(chain):
                    break
                if not _compressed(pending):
                    return end
                z = zlib.decompressobj(47)
            try:
                some = bool(z.decompress(pending, 1 << 20)) or some
            except zlib.error:
                return end if end is not None else k if some else None
            if z.eof:
                pending, z, end = z.unused_data, None, k
            else:
                pending = z.unconsumed_tail
    return len(chain) - 1 if z is not None else end


def _joined(text: str, chain: list[Span], first: int) -> int:
    """The last of the lines from ``first`` on that make up one run: those of
    compressed data, which knows its end; else those that decode to text;
    with bytes that are no text, the lines of one width and the one after them."""
    rest, last = "", first
    if ((head := _decoded(text[chain[first][0]:chain[first][0] + 4])) and _compressed(head)
            and (end := _stream_line(text, chain, first)) is not None):
        return end
    utf8 = codecs.getincrementaldecoder("utf-8")()
    for k, (s, e) in enumerate(chain[first:], first):
        rest += text[s:e].rstrip("=")
        cut = len(rest) // 4 * 4
        left = rest[cut:]
        try:
            data = _decoded(rest[:cut]) or b""
            utf8.decode(data)
            # does the text end with this line?
            state, tail = utf8.getstate(), _decoded(left) if left else b""
            fits = tail is not None and not any(b < 9 for b in tail) and _is_text(state[0] + tail)
        except UnicodeDecodeError:
            return max(last, _width_line(chain, first))
        if any(b < 9 for b in data):
            return max(last, _width_line(chain, first))
        if fits:
            last = k
        rest = left
    return last


def _width_line(chain: list[Span], first: int) -> int:
    """The last line of a block of one width, the shorter line after it included."""
    width, k = chain[first][1] - chain[first][0], first
    while k + 1 < len(chain) and chain[k + 1][1] - chain[k + 1][0] == width:
        k += 1
    return k + (k + 1 < len(chain) and chain[k + 1][1] - chain[k + 1][0] < width)


def _is_text(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _base64(layer: Layer) -> Iterator[Layer]:
    """A layer for every base64 run that holds something readable or compressed."""
    for lines in _runs(layer.text):
        run = "".join(layer.text[s:e] for s, e in lines).rstrip("=")
        if len(run) % 4 == 1:
            run = run[:-1] if len(lines) > 1 else run  # a word after compressed data
        data = _decoded(run)
        if data is None:
            continue
        if _compressed(data):
            whole = layer.origin(lines[0][0], lines[-1][1])
            k = -1
            for k, text in enumerate(_inflated(data)):
                yield Layer(text, Whole(whole, k > 0), (*layer.path, "base64", "compressed"))
            if k >= 0:
                continue
        wide, narrow = _wide(data), _is_text(data) or READABLE.search(data)
        if not wide and not narrow:
            continue
        if len(lines) == 1:
            start, end = lines[0]
            spans = [layer.origin(start + 4 * (k // 3), min(start + 4 * (k // 3) + 4, end)) for k in range(len(data))]
        else:
            at = [i for s, e in lines for i in range(s, e)]
            spans = [layer.origin(at[4 * (k // 3)], at[min(4 * (k // 3) + 4, len(at)) - 1] + 1) for k in range(len(data))]
        for way in ([None] if narrow else []) + ([wide] if wide else []):
            yield Layer(*_characters(data, spans, way), (*layer.path, "base64"))


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Finds in decoded layers, as spans of the original text. Kinds carry the
    way: ``base64>assign``."""
    out: set[tuple[str, int, int]] = set()
    seen = {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), None)}
    work = [(Layer(text, None, ()), None)]
    while work:
        layer, opened = work.pop()
        opened = opened or itertools.chain(_escapes(layer), _base64(layer))
        for new in opened:
            place = new.origin(0, len(new.text)) if new.text else None
            mark = (hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest(), place)
            if not new.text or mark in seen:
                continue
            seen.add(mark)
            work.append((new, None))
            for kind, s, e in base_spans(new.text):
                at = new.origin(s, e)
                # what the parent layer shows as it stands is not found anew
                if (kind, *at) not in layer.shown:
                    out.add((">".join((*new.path, kind)), *at))
            if isinstance(new.spans, Whole) and new.spans.later:
                # a later block is opened before the next one is read, so blocks do not pile up
                work.insert(-1, (layer, opened))
                break
    ways: dict[tuple[str, int, int], str] = {(k, s, e): "" for k, s, e in base_spans(text)}
    for way, s, e in sorted(out, key=lambda x: (x[0].count(">"), x)):
        ways.setdefault((way.rpartition(">")[2], s, e), way)  # the shortest way to a find is enough
    return [(way, s, e) for (_, s, e), way in ways.items() if way]


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, then longer ways by name."""
    def order(x):
        kind = x[0].rpartition(">")[2]
        return x[1], ">" in x[0], KINDS.index(kind) if kind in KINDS else len(KINDS), x[0], x[2]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=order))


def find(text: str | None) -> tuple[int, int, int, str, str]:
    base = base_spans(text or "")
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    more = added_spans(text) if text else []
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans. A null text counts as empty: no finds, and the digest of the empty
    string. Repeated rows are judged alike."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in batches:
            found = [find(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             names=["doc_id", *names])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def masked(text: str, spans: str, mark: str = "*") -> str:
    """The text with all found spans overwritten; lengths stay."""
    out = list(text)
    for part in filter(None, spans.split(",")):
        _, s, e = part.rsplit(":", 2)
        out[int(s):int(e)] = mark * (int(e) - int(s))
    return "".join(out)
