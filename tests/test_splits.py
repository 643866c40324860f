"""Large files: parsed split by split, and told by their content, against one pass over the whole file."""

import gzip
import random
import zlib

import pytest

from seqscan.sources import fasta, records, splits


def plain(content, permissive=True):
    return [(n, h.decode("latin-1"), s.decode("latin-1"), None if q is None else q.decode("latin-1")) for n, (h, s, q) in enumerate(records.parse(content, permissive))]


def reads(r, n, end="\n"):
    """FASTQ records whose qualities begin with any of the three marks."""
    out = []
    for i in range(n):
        length = r.choice([0, 1, 7, 30, 80])
        word = lambda letters: "".join(r.choice(letters) for _ in range(length))
        out.append(f"@r{i}{end}{word('ACGT')}{end}+{r.choice(['', 'again'])}{end}{word('@>+IJ@@')}{end}")
    return "".join(out).encode()


def sequences(r, n):
    return "".join(f">s{i} x>y@z\n" + "".join("".join(r.choice("ACDE") for _ in range(r.randrange(30))) + r.choice(["\n", "\r\n", "\n\n"]) for _ in range(r.randrange(5))) for i in range(n)).encode()


CONTENTS = {
    "reads": reads(random.Random(1), 300),
    "reads with returns": reads(random.Random(2), 300, "\r\n"),
    "sequences": b"junk\nmore > first\nAC\n" + sequences(random.Random(3), 200),
    "mixed": b"".join(f(random.Random(i), 5) for i in range(40) for f in (reads, sequences)),
    "one long": b">long\n" + b"\n".join([b"ACGT" * 10] * 500) + b"\n>next\nA",
    "long quality": b"@q\n" + b"\n".join([b"ACGT" * 10] * 200) + b"\n+\n" + b"\n".join([b"@>+I" * 10] * 200) + b"\n>next\nA\n",
    "odd returns": b">a\n\r\n\r\nAC\r\n\r\n@b\n\n\r\nA\n+\n\r\n\r\nI\n>c\n" * 40,
    "bad quality": reads(random.Random(4), 100) + b"@bad\nACGT\n+\nIII\n@IIII\n" + reads(random.Random(5), 100),
    "no record": b"nothing here\n" * 100,
    "open end": reads(random.Random(6), 60) + b"@last\nACGTACGT\n+\nII",
}


@pytest.fixture
def cut_small(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "5000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_equal_one_pass(spark, tmp_path, cut_small):
    for name, content in CONTENTS.items():
        (tmp_path / f"{name}.fa").write_bytes(content)
    splits_of = splits.lines_of_splits(spark, [str(tmp_path)]).select("file", "block").distinct().count()
    assert splits_of > 2 * len(CONTENTS)
    got = splits.read_split(spark, [str(tmp_path)], permissive=True).collect()
    for name, content in CONTENTS.items():
        assert sorted(tuple(r)[1:] for r in got if r.file.replace("%20", " ").endswith(f"/{name}.fa")) == plain(content), name


@pytest.mark.parametrize("name", ["bad quality", "open end"])
def test_bad_quality_raises(spark, tmp_path, cut_small, name):
    (tmp_path / "x.fq").write_bytes(CONTENTS[name])
    with pytest.raises(Exception, match="quality of"):
        splits.read_split(spark, [f"file:{tmp_path}/x.fq"]).collect()


def walked(pieces, block=0):
    """The records of a content cut at given lines, state by state, without Spark."""
    known = {("f", i): splits.summed(iter(p), i) for i, p in enumerate(pieces)}
    facts = {}
    while True:
        found = splits.entries(known, facts)
        for (f, i), (state, _) in found.items():
            walker = splits.Walker(state, i)
            for line in pieces[i]:
                walker.take(line)
            facts[f, i, state] = walker.state(), walker.begun
        if splits.entries(known, facts) == found:
            return [found[f, i] for f, i in sorted(found)], len(facts)


@pytest.mark.parametrize("name", CONTENTS)
def test_states_compose(name):
    r = random.Random(0)
    lines = CONTENTS[name].split(b"\n")[:-1]
    for _ in range(20):
        cuts = sorted(r.sample(range(1, len(lines)), min(6, len(lines) - 1)))
        pieces = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
        states, _ = walked(pieces)
        one, at, want = splits.Walker(splits.State(), 0), 0, []
        for piece in pieces:
            s = one.state()
            want.append((s.kind, s.sequence, s.quality, one.begun))
            for line in piece:
                one.take(line)
        assert [(s.kind, s.sequence, s.quality, n) for s, n in states] == want


def test_content_tells_gzip_at_any_size(spark, tmp_path):
    content = b"junk\n" + sequences(random.Random(8), 40) + reads(random.Random(9), 40)
    members = gzip.compress(content[:500]) + gzip.compress(content[500:])
    raw = zlib.compressobj(wbits=31, level=0)
    stored = raw.compress(content) + raw.flush()
    names = {"a.fa": members, "b.gz": content, "c": members, "d.fastq.gz": members, "e.bz2": content, "f.fa": content, "g": stored, "h.x.fa": stored, "i.gz": b"", "j.fa": gzip.compress(b"")}
    for name, data in names.items():
        (tmp_path / name).write_bytes(data)
    for large in (10, 1 << 20):
        got = fasta.read_sequences(spark, str(tmp_path), large=large).collect()
        for name, data in names.items():
            own = sorted(tuple(r)[1:] for r in got if r.file.endswith(f"/{name}"))
            assert own == ([] if name in ("i.gz", "j.fa") else plain(content)), (name, large)


def test_inflated_lines_in_pieces():
    content = b"".join(b"line %d\n" % i for i in range(5000)) + b"end"
    packed = gzip.compress(content[:9000]) + gzip.compress(content[9000:]) + b"\0\0\0"
    for step in (1, 100, 1 << 20):
        pieces = [packed[i : i + step] for i in range(0, len(packed), step)]
        assert list(records.inflated_lines(pieces, 1000)) == content.split(b"\n")
    with pytest.raises(records.FormatError):
        list(records.inflated_lines([packed[:-40]]))


def test_pairs_of_several_files(spark, tmp_path):
    for side in "lr":
        (tmp_path / side).mkdir()
        for name in ("one.fq", "two.fq"):
            (tmp_path / side / name).write_text("".join(f"@{side}{name}{i}\nA\n+\nI\n" for i in range(2)))
    got = fasta.pairs(fasta.read_sequences(spark, f"{tmp_path}/l"), fasta.read_sequences(spark, f"{tmp_path}/r"))
    assert sorted((r.header_1, r.header_2) for r in got.collect()) == [(f"l{n}{i}", f"r{n}{i}") for n in ("one.fq", "two.fq") for i in range(2)]


def test_gzip_without_any_suffix_comes_in_order(spark, tmp_path, cut_small):
    content = reads(random.Random(11), 250)
    raw = zlib.compressobj(wbits=31, level=0)
    (tmp_path / "raw").write_bytes(raw.compress(content) + raw.flush())
    assert splits.lines_of_splits(spark, [str(tmp_path)]).select("block").distinct().count() > 3
    got = fasta.read_sequences(spark, str(tmp_path), large=10).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.ordinal)] == plain(content)
