"""Fill-in-middle, filter audit and WARC archives against brute force, exact round trips and broken archives."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import fill_middle, filter_audit, warc
from panelspark.llm.common import staged
from panelspark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, n string, part string, mask string, sha string, output string, form string"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def awkward_docs(spark):
    texts = [None, "", " \t\n", "one", " lead and trail ", "größe über 日本語  x 🙂 end\n", "has <P> inside", "half <S", "x" * 70_000, " ".join(f"w{i % 911} é{i % 7}" for i in range(40_000)), "CAPS AND #money", "same text", "same text", "a b a b a b", "CAPS AND #money"]
    rows = [(i, t, None, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(11, "same text", None, "s9"), (None, "same text", None, "s1"), (None, None, None, None), (11, "same text", None, "s9"), (-3, "same text", None, "")]
    rows += [(100 + i, f"doc {i} " + "word " * (i * 7), None, f"s{i % 2}") for i in range(20)]
    return spark.createDataFrame([(*r, 0, *["clash"] * 7) for r in rows], DOCS), rows


def fim_of(doc_id, text):
    """By slices of decoded text."""
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if spm else "psm", len(pre), len(mid), out


def test_fill_in_middle_against_slices(spark):
    docs, rows = awkward_docs(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fill_middle.restored_texts(fill_middle.fill_in_middle(docs)).collect()
    want = Counter((r[0], *fim_of(r[0], r[1]), r[1] or "") for r in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sha("") in {sha(r.output) for r in got}


def test_fill_in_middle_of_other_identifiers_and_rates(spark):
    docs = spark.createDataFrame([(f"id-{i}", f"a b c d {i}") for i in range(50)], "key string, body string")
    got = fill_middle.fill_in_middle(docs, percent=100, spm_percent=0, id_col="key", text_col="body").collect()
    assert {r.form for r in got} == {"psm"} and {r.doc_id for r in got} == {f"id-{i}" for i in range(50)}
    assert fill_middle.fill_in_middle(docs.limit(0), id_col="key", text_col="body").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <P>SM\té🙂\n", max_size=60), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_rotations_restore_exactly(text, x, y, form):
    data = text.encode()
    ends = [0, *fill_middle.unit_ends(data).tolist()]
    assert [data[i:j].decode() for i, j in zip(ends, ends[1:], strict=False)] == UNITS.findall(text)
    if any(s in data for s in (b"<P>", b"<S>", b"<M>")):
        return
    a, b = sorted((ends[x % len(ends)], ends[y % len(ends)]))
    assert fill_middle.restore(fill_middle.arrange(data, a, b, form), form) == data


def test_reversal_by_small_blocks(monkeypatch):
    import numpy as np

    for block in (1, 2, 3, 7):
        monkeypatch.setattr(fill_middle, "BLOCK", block)
        for n in range(12):
            v = np.arange(n)
            fill_middle.reverse(v, 0, n)
            assert v.tolist() == list(range(n))[::-1]


def audit_of(docs, labels, names="ABCDE"):
    """Every order run through the documents, one filter after the other."""
    first = {}
    for i, t, _, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t) is not None, i is not None and i > first[t])
        return {n for n, x in zip("ABCDE", tests, strict=True) if x}

    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for i, t, _, s in docs:
        parts.setdefault(s or "", []).append((i, fails(i, t)))
    out = {}
    for part, rows in parts.items():
        removed_by = Counter()
        for order in permutations(names):
            left, seen = rows, set()
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in r[1] and bool(r[1] & seen) for r in rows), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                left = stay
                seen.add(f)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_against_running_every_order(spark):
    docs, rows = awkward_docs(spark)
    marks = [(11, 1, None), (11, 0, 1), (12, 1, 0), (14, None, 1), (100, 1, 1), (105, 0, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame([(*m, "y") for m in marks], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audit_of(rows, marks)
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    unlabelled = filter_audit.filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


def test_lattice_paths():
    for n in range(1, 6):
        reach, leave = filter_audit.lattice(n)
        for s in range(1 << n):
            k = s.bit_count()
            assert (reach[s], leave[s]) == (math.factorial(k), math.factorial(n - k))


def test_order_effects_of_three_filters(spark):
    counts = spark.createDataFrame([("p", 0b011, 4, 1, 0), ("p", 0b100, 2, 0, 2), ("p", 0, 5, 0, 0), ("p", 0b011, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in filter_audit.order_effects(counts, "xyz").collect()}
    assert len(got) == 18
    assert (got["xyz", 1].removed, got["xyz", 2].removed, got["xyz", 2].redundant, got["xyz", 3].kept, got["xyz", 3].toxic_lost) == (5, 0, 5, 5, 2)
    assert [got["xyz", s].shapley for s in (1, 2, 3)] == [15, 15, 12]  # five shared by two filters, two of one filter, six orders
    with pytest.raises(ValueError):
        filter_audit.order_effects(counts, "xx")


PAGES = "page_id long, url string, html string, sha string, first string, payload string"


def awkward_pages(spark):
    long = "<html>" + "é paragraph of the page " * 9000 + "</html>"
    body = "<html>" + "shared " * 30 + "</html>"
    rows = [(5, "http://a/5", body), (3, "http://a/3", body), (9, None, body), (None, "http://n", body), (3, "http://a/3b", body), (1, "http://a/1", "short"), (2, "", "short"), (7, "http://x y/\r\nInjected: 1", None), (8, "http://ü/8", ""), (20, "u", long), (21, "u", long), (None, "only", "q" * 200), (30, "e", "x" * 99), (31, "e", "x" * 99), (32, "e", "y" * 100), (33, "e", "y" * 100), (4, "z", "🙂" * 40), (6, "z", "🙂" * 40)]
    rows += [(100 + i, f"http://site/{i}", f"<html><p>page number {i % 150} with its own words {i % 150 * 7919}</p><footer>the same footer everywhere</footer></html>") for i in range(300)]
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES), rows


def warc_of(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(data)
        revisit = f is not None and f != i
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None] += 1
    return out


@pytest.mark.parametrize("broadcast_rows", [warc.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 2000])
def test_archives_round_trip(spark, broadcast_rows, archive_bytes):
    pages, rows = awkward_pages(spark)
    got = warc.archive_pages(pages, payloads=True, broadcast_rows=broadcast_rows, archive_bytes=archive_bytes).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == warc_of(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert {r.target_uri for r in got if r.page_id in (7, 9, 8)} == {"http://x%20y/%0D%0AInjected:%201", "urn:x-page:9", "http://ü/8"}


def test_no_pages_and_no_copies(spark, tmp_path):
    pages, _ = awkward_pages(spark)
    pages.limit(0).write.parquet(f"{tmp_path}/a/pages.parquet")
    assert QUERIES["op13_warc"](spark, f"{tmp_path}/a").count() == 0
    pages.where("page_id < 3").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert {r.record_type for r in QUERIES["op13_warc"](spark, f"{tmp_path}/b").collect()} == {"response"}


def test_archives_outside_the_manifest_are_not_read(spark, tmp_path):
    pages, rows = awkward_pages(spark)
    folder = f"file://{tmp_path}"
    written = warc.with_firsts(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")))
    manifest = staged(warc.write_archives(written, folder))
    staged(warc.write_archives(written, folder))  # a repeated attempt
    assert len(list(tmp_path.glob("*.warc.zst"))) == 2 * manifest.count()
    got = warc.read_archives(manifest, folder, payloads=False)
    assert got.count() == len(rows) and got.where("payload IS NOT NULL").count() == 0
    short = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(short, folder).collect()


def archive(tmp_path, n=200):
    writer = warc.ArchiveWriter(f"file://{tmp_path}", "2024-01-01T00:00:00Z", warc.ARCHIVE_BYTES)
    for i in range(n):
        payload = f"<html><p>page {i} and {i * i}</p><footer>{'the same footer everywhere ' * 5}</footer></html>".encode()
        writer.add(warc.page_record(i, f"http://s/{i}", payload, None, writer.date))
    writer.close()
    ((path, records, size),) = writer.finished()
    data = open(path, "rb").read()
    assert records == n and size == len(data)
    return data


def test_dictionary_comes_from_the_leading_frame(tmp_path):
    data = archive(tmp_path)
    dictionary, start = warc.leading_dictionary(memoryview(data))
    assert dictionary is not None and start > 8
    assert sum(1 for _ in warc.archive_records(data, "x")) == 201  # and one warcinfo
    raw = dictionary.as_bytes()
    plain = len(raw).to_bytes(4, "little")
    stored = b"\x5d\x2a\x4d\x18" + plain + raw + data[start:]  # a dictionary that is not compressed
    assert [x[1:] for x in warc.archive_records(stored, "x")] == [x[1:] for x in warc.archive_records(data, "x")]
    with pytest.raises(warc.WarcError):
        list(warc.archive_records(data[start:], "x"))  # frames that need a dictionary that is not there
    few = archive(tmp_path / "..", n=3)
    assert warc.leading_dictionary(memoryview(few)) == (None, 0) and sum(1 for _ in warc.archive_records(few, "x")) == 4
    # one frame is one record
    view, at, frames = memoryview(data), start, 0
    while at < len(view):
        at, frames = warc.frame_end(view, at), frames + 1
    assert frames == 201


def frame(record):
    return zstandard.ZstdCompressor(write_content_size=True).compress(record)


GOOD = warc.page_record(1, "http://a", b"payload", None, "2024-01-01T00:00:00Z")


def unblocked(record):
    """Without the block digest, so that later checks are reached."""
    return re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", record)


@pytest.mark.parametrize(
    "record",
    [
        GOOD.replace(b"WARC/1.1", b"WARC/9.9"),
        GOOD.replace(b"WARC-Type: response\r\n", b""),
        GOOD.replace(b"WARC-Type: response", b"WARC-Type response"),
        GOOD.replace(b"WARC-Date", b"WARC-Type"),
        re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: 1\1\r\n\r\nHTTP", GOOD),
        re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: -5\r\n\r\nHTTP", GOOD),
        GOOD + GOOD,
        GOOD[:-4],
        GOOD.replace(b"payload\r\n", b"paYload\r\n"),
        unblocked(GOOD).replace(b"payload\r\n", b"paYload\r\n"),
        unblocked(GOOD).replace(b"HTTP/1.1 200", b"JUNK/1.1 200"),
        unblocked(GOOD).replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        b"",
    ],
)
def test_broken_records_are_errors(record):
    def read(data):
        return [warc.payload_of(h, b, w) for w, h, b in warc.archive_records(data, "x")]

    assert read(frame(GOOD))[0][2] == b"payload"
    with pytest.raises(warc.WarcError):
        read(frame(record))


def test_broken_frames_are_errors(tmp_path):
    data = archive(tmp_path)
    for bad in (data[:-1], data[:10], data[:-200] + b"\0" * 200, data + b"junk", b"\x5d\x2a\x4d\x18\x08\0\0\0notadict" + data):
        with pytest.raises(warc.WarcError):
            list(warc.archive_records(bad, "x"))
    assert sum(1 for _ in warc.archive_records(frame(GOOD) + b"\x50\x2a\x4d\x18\x02\0\0\0hi" + frame(GOOD), "x")) == 2  # another skippable frame
    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    with pytest.raises(warc.WarcError):
        list(warc.archive_records(streamed.compress(GOOD) + streamed.flush(), "x"))
