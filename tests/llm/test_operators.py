"""The other operators against brute force, exact round trips or held-out accuracy, on awkward tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm import corpus
from turnlattice.llm import bpe_reuse, chunks, language_id, line_spread, media_chunks, packing, simhash, toxicity, url_rules

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return corpus.table(spark, tmp_path_factory.mktemp("docs") / "d").cache()


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "B", "é", "'s", "'", "'ll", " ", "  ", "\n", "\n\n", "\t", "7", "!", "%%", "\u00a0", "\u3000", "日本", "<|endoftext|>", "\x1c", "\u0301", "\u0130", "ß", "'S", "_", "\r\n", "😀", "\0", "\x85", "²", "Ⅷ"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


# language ID


def test_language(spark):
    rnd = random.Random(3)
    alphabet = {"en": "the and of water house ".split(), "de": "der und nicht wasser haus ".split(), "fr": "le et pas eau maison ".split()}
    rows = [(i, " ".join(rnd.choice(alphabet[lang]) for _ in range(40)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.training(train))
    held = {r.doc_id: r for r in language_id.identified(train, model).collect()}
    assert all(held[i].lang_pred == lang and not held[i].rejected and 0 <= held[i].score <= 1 for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "これは日本語の文章です。とても長い文章です。")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.identified(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[4].rejected


def test_language_on_nothing(spark):
    model = language_id.fit(language_id.training(corpus.empty(spark)))
    out = language_id.identified(corpus.documents(spark), model)
    assert {r.lang_pred for r in out.collect()} == {"und"}


# line dedup


def test_lines(spark, docs):
    line = "Released under some licence of ours"
    rows = [(i, f"{line}\nown line number {i} is here\n{'rare enough to stay' if i < 5 else f'own {i}'}", f"s{i % 12}") for i in range(40)] + [(100, None, "s1"), (101, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_spread.without_boilerplate(frame).collect()}
    for i, text, _ in rows[:40]:
        assert out[i].text == text.split("\n", 1)[1] and out[i].n_removed == 1
    assert out[100].text is None and out[101].text == "" and len(out) == 42
    short = spark.createDataFrame([(i, f"  Share \nown {i}\n\n \nend", f"s{i % (12 if i < 30 else 3)}") for i in range(40)], "doc_id long, text string, source string")
    assert {r.text.split("\n", 1)[1] for r in line_spread.without_boilerplate(short).collect()} == {"\n "}  # short lines go, empty ones stay
    near = line_spread.without_boilerplate(frame, min_sites=13)  # twelve sites only
    assert near.filter("n_removed > 0").count() == 0
    assert line_spread.without_boilerplate(docs).count() == docs.count()


# media


def test_cuts_follow_contents():
    rnd = random.Random(5)
    shared = rnd.randbytes(60_000)
    a, b = rnd.randbytes(7000) + shared, rnd.randbytes(12_345) + shared
    parts = lambda d: {d[i:j] for i, j in zip([0, *chunks.cuts(d)[:-1]], chunks.cuts(d))}
    assert sum(map(len, parts(a) & parts(b))) > 45_000
    for d in (a, b, b"", b"x", b"\0" * 30_000):
        ends = chunks.cuts(d)
        assert ends == sorted(set(ends)) and ends[-1] == len(d)


def test_media(spark, docs):
    texts = Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    got = Counter()
    for r in media_chunks.media_columns(docs).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature] += 1
    want = Counter()
    for (i, data), n in texts.items():
        p = data + b"\0" * (-len(data) % 64 if data else 64)
        wav = media_chunks.header(len(p)) + p
        assert struct.unpack("<I", wav[40:44])[0] == len(p) and media_chunks.samples(wav) == p
        want[i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), media_chunks.feature(p)] += n
    assert got == want
    media, store = media_chunks.stored(docs)
    assert media.filter("size(shared) > 0").count() > 0 and store.count() == store.select("digest").distinct().count() > 0
    assert media_chunks.media_columns(corpus.empty(spark)).count() == 0


# packing


def test_byte_encoder_is_the_library():
    encode, lib = packing.ByteEncoder(BYTES), library(BYTES)
    for text in [*fuzz(1500), "a\n", "a\n\n", "a \n ", "a  b", "a   b", " the, end."]:
        assert list(struct.unpack(f"<{len(encode.ids(text)) // 4}I", encode.ids(text))) == lib.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, docs):
    lib = library(BYTES)
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(lib.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = packing.packed(docs, BYTES).collect()
    rows = defaultdict(list)
    for p in pieces:
        rows[p.sequence_id].append(p)
    padding = 0
    for own in rows.values():
        own.sort(key=lambda p: p.offset)
        fill = 0
        for p in own:
            assert p.offset == fill and p.length > 0
            fill += p.length
        assert fill <= 2048
        padding += 0 if fill & (fill - 1) == 0 else 2048 - fill
    assert padding == 0
    assert sum(p.length for p in pieces) == sum(len(x) for own in ids.values() for x in own)
    by_doc = defaultdict(Counter)
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(struct.pack(f"<{p.length}I", *x[p.start : p.start + p.length])) == p.ids_crc32 for x in ids[p.doc_id])
        by_doc[p.doc_id].update(range(p.start, p.start + p.length))
    for i, own in ids.items():
        want = Counter()
        for x in own:
            want.update(range(len(x)))
        assert by_doc[i] == want
    assert packing.packed(corpus.empty(spark), BYTES).count() == 0


# SimHash


def slow_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Print -> smallest id reachable, by all pairs."""
    values = sorted(prints)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for v in values:
        least[find(v)] = min(least.get(find(v), 10**9), prints[v])
    return {v: least[find(v)] for v in values}


def test_simhash(spark, docs):
    rows = docs.filter("doc_id is not null").collect()
    prints = {}
    for r in rows:
        v = slow_print(r.text or "")
        prints[v] = min(prints.get(v, 10**9), r.doc_id)
    want = slow_components(prints)
    got = simhash.near_duplicates(docs.filter("doc_id is not null")).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r.doc_id, f"{slow_print(r.text or ''):016x}", want[slow_print(r.text or "")]) for r in rows)


@pytest.mark.parametrize("hot", [64, 3])
def test_links_and_components(spark, hot):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    values = set(centres)
    for c in centres:  # chains and clouds around each centre
        at = c
        for _ in range(25):
            at ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.6:
                at ^= 1 << rnd.randrange(20)
            values.add(at)
    prints = {v: i for i, v in enumerate(sorted(values))}
    signed = {v: v - 2**64 if v >= 2**63 else v for v in prints}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = {(r.a, r.b) for r in simhash.links(nodes, hot=hot).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    want = slow_components(prints)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(list(found), "a long, b long")).collect()}
    group = lambda v: roots.get(signed[v], signed[v])
    for a in values:
        for b in values:
            assert (want[a] == want[b]) == (group(a) == group(b))


# toxicity


def test_toxicity(spark):
    rnd = random.Random(4)
    mild, bad = [f"w{i}" for i in range(60)], ["awful", "nasty"]
    rows, labels = [], []
    for i in range(300):
        sentences = [" ".join(rnd.choice(mild) for _ in range(8)) for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            sentences[3] = f"you {rnd.choice(bad)} {sentences[3]}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.training(marks))
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert sum(out[i].predicted == t for i, t in labels) >= 295
    assert all(out[i].worst_sentence == 3 and out[i].n_offending >= 1 for i, t in labels if t and out[i].predicted)
    odd = toxicity.scored(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert all(0 <= r.score < 0.5 and r.predicted == 0 for r in odd)
    nothing = toxicity.fit(docs.limit(0), marks)
    assert toxicity.scored(docs.limit(3), nothing).filter("predicted = 0").count() == 3


# BPE


def test_chunked_encoding_is_the_library():
    encode, lib, rnd = bpe_reuse.WordEncoder(WORDS), library(WORDS), random.Random(2)
    for text in fuzz(1000, 2):
        want = lib.encode(text, add_special_tokens=False).ids
        ids, shown = encode.both(text)
        assert ids == " ".join(map(str, want)) and shown == lib.decode(want, skip_special_tokens=False) == encode.decode(ids)
        data = text.encode()
        cut = sorted({chunks._boundary(data, rnd.randint(0, len(data))) for _ in range(4)} | {len(data)})
        parts = [data[i:j] for i, j in zip([0, *cut[:-1]], cut) if j > i] or [b""]
        assert bpe_reuse.joined(encode, [bpe_reuse.encoded_chunk(encode, p) for p in parts]) == ids


def test_bpe(spark, docs):
    lib, want = library(WORDS), Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe_reuse.encoded(docs, WORDS).collect()) == want
    assert bpe_reuse.encoded(corpus.empty(spark), WORDS).count() == 0


# URLs


def judge(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark):
    rnd = random.Random(8)
    hosts, paths = ["com", "example.com", "a.example.com", "b.org", "example.net", "net", "xexample.com"], ["", "/", "/en/", "/en/7", "/en/77/x", "/de/8", "/e"]
    rules = sorted({(rnd.choice(hosts), rnd.choice(paths)) for _ in range(25)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules] + url_rules.RULES[:0]
    urls = [None, "", "no scheme", "http://", "x://y://z", "HTTP://EXAMPLE.com/EN/7", "http://example.com?x=/en/", "http://com#/en/"]
    urls += [f"http://{rnd.choice(['', 'm.', 'É.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q', '#f', '5'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, None, "x", "x")], "page_id long, url string, host string, verdict string")
    for salt in (50_000, 7):
        got = Counter(tuple(r) for r in url_rules.judged(pages, url_rules.rule_table(spark, rules), urls_a_salt=salt).collect())
        want = Counter((i, *judge(u, rules)) for i, u in [*enumerate(urls), (0, None)])
        assert got == want
    assert url_rules.judged(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
