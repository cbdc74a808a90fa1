"""Corpus operators on small fixtures, against plain versions; hard rows in each."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from dyadloom.llm import bpe, mixing, nearest, pii, queries, sharding, simhash, substring, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, batch string, shard int, known string"
random.seed(7)
VOCAB = [f"w{k}" for k in range(60)]
BASE = " ".join(random.choice(VOCAB) for _ in range(120))


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def _rows():
    texts = [prose(random.randint(1, 90)) for _ in range(30)]
    texts += [BASE] * 4 + [BASE.replace("w1 ", "W1 ", 3), BASE + " tail", "x " + BASE, prose(40) + " " + BASE[:200] + " " + prose(30)]
    texts += [None, "", " \t\n", "one", "one two", "same " * 70, "ends with é space  \n\n", "<|endoftext|> in text", prose(30_000)]
    texts += ["Mail a.b@mail1.example.com or +1 (663) 555-6869, 10.1.2.3. Card 4111111111111111", "A.B@MAIL1.EXAMPLE.COM and +16635556869!"]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), 1, "b", 2, "k") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, BASE, None, "s0", None, None, None, None, None)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash(docs, empty):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [(r[0], plain(r[1])) for r in ROWS]
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(((i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints)), key=str)
    got = simhash.near_duplicates(docs)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_finds_all_close_pairs():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    flip = np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    x = np.unique(np.concatenate([x, x ^ flip, x[:1] ^ np.arange(150, dtype=np.uint64)]))
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)) if i < j}
    got = [p for i, j in simhash.trie_links(x, None, 0, 0, 2) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeats_go(docs, empty, monkeypatch):
    rows = [r for r in ROWS if r[0] is not None][:-1]
    words = {r[0]: (r[1] or "").encode().split() for r in rows}
    first, want = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][k : k + 20]), (i, k))
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                keep[k : k + 20] = [False] * 20
        want[i] = (len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep) if y).decode())
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(once).collect()}
    assert got == want
    every = substring.without_repeats(docs).collect()
    assert len(every) == len(ROWS) and [r.n_removed for r in every if r.doc_id is None] == [120]
    assert substring.without_repeats(empty).count() == 0


def test_tokens(docs, empty):
    codec = bpe.Codec(bpe.public_vocabulary())
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.encode_and_decode(docs, bpe.public_vocabulary()).collect()), key=str)
    plain = lambda t: codec.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert got == sorted(((r[0], plain(r[1]), codec.tokenizer.decode(plain(r[1]), skip_special_tokens=False)) for r in ROWS), key=str)
    assert bpe.encode(empty, bpe.public_vocabulary()).count() == 0
    back = bpe.decode(bpe.encode(docs, bpe.public_vocabulary()), bpe.public_vocabulary())
    assert sorted(((r.doc_id, r.decoded) for r in back.collect()), key=str) == [(i, t) for i, _, t in got]


def test_joins_of_odd_texts():
    codec = bpe.Codec(bpe.public_vocabulary())
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "é", "1", "'s", "<|endoftext|>", "!", ". ", "日", "　", "\t"]) for _ in range(rng.randint(0, 9000)))
        assert codec.encode(text.encode()) == codec.whole(text.encode())


def _vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8)], 0) for k in range(400)]
    rows[7] = (7, rows[50][1], 0)
    rows[9] = (9, rows[50][1], 0)
    odd = [(500, None, 1), (550, [], 1), (600, [0.0] * 8, 1), (650, [float("nan")] * 8, 1), (700, [None] + [1.0] * 7, 1), (750, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (800, [1.0, 2.0], 1)]
    rows.append(rows[3])  # every row is a candidate, a repeated one twice
    return rows, spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("kind", ["cosine", "product"])
def test_nearest(spark, kind):
    rows, df = _vectors(spark)
    x = np.array([r[1] for r in rows])
    y = x if kind == "cosine" else np.floor(256 * x)
    if kind == "product":  # zero vectors take part there
        rows, y = [*rows, (600, [0.0] * 8, 1)], np.vstack([y, np.zeros(8)])
    ids = [r[0] for r in rows]
    want = []
    for a, q in enumerate(ids):
        if q % 50 == 0:
            s = [(float((y[a] * y[b]).sum() / (np.sqrt((y[a] ** 2).sum()) * np.sqrt((y[b] ** 2).sum()))) if kind == "cosine" else int(y[a] @ y[b]), ids[b]) for b in range(len(ids)) if b != a]
            want += [(q, k + 1, i, v) for k, (v, i) in enumerate(sorted(s, key=lambda p: (-p[0], p[1]))[:5])]
    found = nearest.nearest_by_cosine(df, factor=1.0) if kind == "cosine" else nearest.top_by_product(df)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert [(g[0], g[1], g[2]) for g in got] == [(w[0], w[1], w[2]) for w in want]
    assert [g[3] for g in got] == [pytest.approx(w[3], abs=1e-12) for w in want]
    none = spark.createDataFrame([], df.schema)
    assert (nearest.nearest_by_cosine(none) if kind == "cosine" else nearest.top_by_product(none)).count() == 0


def test_shards(docs, empty, spark):
    limit = 2000
    got = sharding.shards(docs, limit, step=2).collect()
    assert len(got) == len(ROWS)
    sums, members = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
        members.setdefault(r.shard, []).append(r)
        assert len(r.shard) == r.depth
    where = {}
    for i, t in ((r[0], r[1]) for r in ROWS):
        text = t or ""
        key = f"{'' if i is None else i}|{hashlib.md5(text.encode()).hexdigest()}"
        bits = f"{int(hashlib.md5(key.encode()).hexdigest()[:9], 16):036b}"
        where.setdefault((i, len(text.encode())), set()).add(bits)
    for r in got:
        assert any(b.startswith(r.shard[:36]) for b in where[r.doc_id, r.n_bytes])
        assert r.shard_bytes == sums[r.shard] and r.oversized == (r.shard_bytes > limit)
        if r.oversized:  # nothing but a row that is too large by itself, and empty ones beside it
            assert sum(m.n_bytes > 0 for m in members[r.shard]) == 1 and r.depth == sharding.BITS
        if 0 < r.depth < sharding.BITS:  # its parent was too large
            assert sum(v for s, v in sums.items() if s.startswith(r.shard[:-1])) > limit
    alike = spark.createDataFrame([(None, "x" * 900, "z")] * 5 + [(4, "y" * 900, "z")] * 5, "doc_id long, text string, hash string")
    assert all(r.shard_bytes <= 2000 for r in sharding.shards(alike, 2000).collect())
    assert sharding.shards(empty).count() == 0


def test_shards_as_in_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = queries.OP3_SQL
    assert sql.count(str(sharding.LIMIT)) == 2
    want = con.execute(f"SELECT doc_id, n_bytes, shard, depth, shard_bytes, oversized FROM ({sql.replace(str(sharding.LIMIT), '100000')})").fetchall()
    got = [tuple(r) for r in sharding.shards(spark.read.parquet(f"{sf}/documents.parquet"), 100_000).collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in got}) > 20


def test_shards_are_written(docs, tmp_path, spark):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


def test_surrogates(docs, empty, spark):
    rows, mapping = pii.replace(docs, "k")
    out = rows.select("row.*").collect()
    assert rows.select("row.*").columns == docs.columns and len(out) == len(ROWS)
    text = {r.doc_id: r.text for r in out}
    swaps = {r.found: r.surrogate for r in mapping.collect()}
    assert len(set(swaps.values())) == len(swaps)
    with_data = [r[0] for r in ROWS if r[1] and "555" in r[1]]
    for r in ROWS:
        if r[0] not in with_data and r[0] is not None:
            assert text[r[0]] == r[1]
    one, two = (text[i] for i in with_data)
    for left in ("a.b@", "663", "10.1.2.3", "4111111111111111"):
        assert left not in one.lower() and left not in two.lower()
    mail = re.search(r"\S+@\S+", one)[0]
    assert mail.upper() in two  # one person, two spellings
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert "+" + re.sub(r"\D", "", phone) in two
    assert re.search(r"Card \d{16}$", one)
    assert pii.replace(empty, "k")[0].count() == 0


def test_collisions_are_drawn_anew(spark):
    rows = spark.createDataFrame([("ssn", f"{k:03d}") for k in range(400)], "kind string, entity string")
    # entities of three digits, 400 of 1000: draws must collide with each other and with entities
    got = pii.entities(rows, "k").collect()
    own = {r.own for r in got}
    assert len(got) == 400 == len(own) and not own & {r.entity for r in got}


def test_names_keep_gender_and_script(spark):
    df = spark.createDataFrame([(1, "Mr. Ivan Petrov saw Mr Ivan Petrov; Frau Anna Schmidt; Госпожа Анна Иванова.")], "doc_id long, text string")
    text = pii.replace(df, "k")[0].first().row.text
    first, second = re.findall(r"Mr\.? ([A-Z]\w+ [A-Z]\w+)", text)
    assert first == second != "Ivan Petrov" and first.split()[0].endswith(pii.ENDINGS["latin"]["m"])
    assert re.search(r"Frau (\w+)", text)[1].endswith(pii.ENDINGS["latin"]["f"]) and re.search(r"Госпожа (\w+)", text)[1].endswith(pii.ENDINGS["cyrillic"]["f"])


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.source_size and r.taken in (0, r.size, 2 * r.size)
    total, want, left = sum(size.values()), {}, dict(zip([*sorted(s for s in size if s is not None), None], [3, 1, 2, 3]))
    while True:  # reshare what is above twice the size until none is
        budget = 1.5 * total - sum(want.values())
        level = budget / sum(left.values())
        full = [s for s, w in left.items() if level * w > 2 * size[s]]
        if not full:
            want |= {s: level * w for s, w in left.items()}
            break
        for s in full:
            want[s] = 2.0 * size[s]
            del left[s]
    assert target == {s: pytest.approx(v) for s, v in want.items()}
    largest = {s: max(r.size for r in got if r.source == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in size)
    again = mixing.mix(docs.repartition(3), bins=7)
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() >= sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


def test_weights_raise_the_odds(spark):
    df = spark.createDataFrame([(k, "w", "s" if k < 2000 else "big") for k in range(12_000)], "doc_id long, text string, source string")
    heavy = spark.createDataFrame([(k, 4.0 if k % 2 else 1.0) for k in range(2000, 12_000)], "doc_id long, weight double")
    got = [r for r in mixing.mix(df, heavy).filter("source = 'big'").collect()]
    copies = [sum(r.copies for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert copies[1] > copies[0]


def test_warc(spark, tmp_path):
    html = ["<p>a</p>\r\n\r\n<p>é</p>", "", None, "x" * 70_000, "<p>a</p>\r\n\r\n<p>é</p>", "WARC/1.1\r\n\r\n"]
    rows = [(k + 10, f"http://h/{k} \r\n", h, "r") for k, h in enumerate(html)] + [(3, None, "x" * 70_000, "r"), (None, "u", "<p>a</p>\r\n\r\n<p>é</p>", "r"), (10, "u", "<p>a</p>\r\n\r\n<p>é</p>", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(3)
    least = {}
    for i, _, h, _ in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        to = least[h or ""] if i != least[h or ""] else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if to is not None else "response", to))
    for chunk in (1000, 1 << 20):
        got = warc.round_trip(pages, chunk=chunk).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    big = [r[3] for r in map(tuple, warc.round_trip(pages, least=10**6).collect())]
    assert big == ["response"] * len(rows)
    chunks = warc.archive_pages(pages, chunk=1000).persist()
    paths = warc.export(chunks, str(tmp_path)).collect()
    assert sum(r.n_bytes for r in paths) == sum(len(r["data"]) for r in chunks.collect())
    assert open(paths[0].path, "rb").read(8) == b"WARC/1.1"
    reader = warc.Reader()
    with pytest.raises(ValueError):
        reader.feed(1, b"WARC/1.1\r\n", b"")
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    bad = ["vilewordone", "vilewordtwo", "grimthing"]
    text = lambda toxic: " ".join([*(rng.choice(VOCAB) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 200))), *(rng.sample(bad, 2) if toxic else [])])
    texts = [(k, k % 5 == 0, text(k % 5 == 0)) for k in range(600)]
    frame = spark.createDataFrame([(k, t) for k, _, t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, y, _ in texts if k < 400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.sample(frame, labels))
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [(y, got[k].predicted) for k, y, _ in texts if k >= 400]
    assert sum(p != y for y, p in held) <= 4
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == bool(r.predicted) for r in got.values())
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    kept = toxicity.keep(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(1 - r.predicted for r in got.values())
    none = toxicity.train([], [b"a"])
    assert math.isclose(toxicity.score(frame, none).agg({"score": "max"}).first()[0], 0, abs_tol=1e-6)


def test_pipeline_stages_agree_with_their_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.count(), stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k < 4:
            assert docs.columns == names
        if k in (0, 1):
            assert 0 < docs.count() <= before
        if k in (2, 4):
            assert docs.count() == before
    assert docs.count() > 0


def _plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _plain_copies(rows, quality):
    """doc_id -> how often the mix takes it, source by source."""
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    of = {}
    for r in rows:
        of.setdefault(r.source, []).append(r.doc_id)
    size = {s: sum(words[i] for i in ids) for s, ids in of.items()}
    named = [*sorted(s for s in of if s is not None), *([None] if None in of else [])]
    left, want = {s: (3, 1, 2)[k % 3] for k, s in enumerate(named)}, {}
    while left:
        level = (1.5 * sum(size.values()) - sum(want.values())) / sum(left.values())
        full = [s for s, w in left.items() if level * w > 2 * size[s]] or None
        for s in full or list(left):
            want[s] = 2.0 * size[s] if full else level * left[s]
            del left[s]
    copies = {}
    for s, ids in of.items():
        def key(i):
            u = (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -math.log(u) / quality.get(i, mixing.UNKNOWN)

        epochs, ahead = math.floor(want[s] / size[s]) if size[s] else 0, 0
        for i in sorted(ids, key=lambda i: (key(i), i)):
            copies[i] = epochs + (ahead + words[i] / 2 < want[s] - epochs * size[s])
            ahead += words[i]
    return copies


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline
    from dyadloom.llm.common import settle

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(settle(stage(spark, frames[-1], sf), f"test-{k}"))
    rows = [f.collect() for f in frames]
    ids = [sorted(r.doc_id for r in part) for part in rows]

    model = toxicity.train(*toxicity.sample(frames[0], labels.filter(queries._KEPT_FOLD)))
    own = toxicity.Comparer(model.toxic, model.ordinary)
    score = lambda t: model.scores(np.array([own.evidence((t or "").encode())]))[0]
    assert ids[1] == sorted(r.doc_id for r in rows[0] if score(r.text) < 0.7)
    assert len(ids[1]) < len(ids[0])

    sets, left, want = [_plain_shingles(r.text) for r in rows[1]], set(range(len(rows[1]))), []
    holders = {}
    for k, own_set in enumerate(sets):
        for x in own_set:
            holders.setdefault(x, []).append(k)
    near = {}
    for k, own_set in enumerate(sets):
        common = Counter(m for x in own_set for m in holders[x])
        near[k] = {m for m, n in common.items() if n / (len(own_set) + len(sets[m]) - n) >= 0.8} or {m for m, x in enumerate(sets) if not x}
    while left:
        todo, group = [left.pop()], []
        while todo:
            group.append(k := todo.pop())
            todo += near[k] & left
            left -= near[k]
        want.append(min(rows[1][k].doc_id for k in group))
    assert ids[2] == sorted(want) and len(want) < len(rows[1])

    before = {r.doc_id: r for r in rows[2]}
    mails = lambda part: {m.lower() for r in part for m in re.findall(r"[A-Za-z0-9.]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r.text or "")}
    assert ids[3] == ids[2] and mails(rows[2]) and not mails(rows[2]) & mails(rows[3])
    for r in rows[3]:
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
    assert 0 < sum(r.text != before[r.doc_id].text for r in rows[3]) < len(rows[3])

    marks = {}
    for r in labels.filter("quality is not null").collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    quality = {i: mixing.POOR + (mixing.GOOD - mixing.POOR) * sum(q) / len(q) for i, q in marks.items()}
    assert ids[4] == sorted(i for i, n in _plain_copies(rows[3], quality).items() for _ in range(n))

    tokenizer = bpe.Codec(bpe.public_vocabulary()).tokenizer
    want = []
    for r in rows[4]:
        got = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(got, skip_special_tokens=False)
        want.append((r.doc_id, got, len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows[5][0].__fields__[:2] == ["doc_id", "ids"]
    assert sorted(map(tuple, rows[5])) == sorted(want)
