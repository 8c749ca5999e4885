"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from shoal.llm import adaptjoin, bpe, disclosure, fixity, markup, radix, simple8b, tiling, weak, words, zlang
from shoal.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, _id string, rest string, size int, x double"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "a", "b", 1, 0.5) for i, t in rows], DOCS)


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(80)) for _ in range(6)]
    rows = [(None, base[0]), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One "), (6, "one  two\x0bthree"), (7, "one two three")]
    for k, text in enumerate(base * 3):
        parts = text.split()
        for _ in range(k % 5):
            parts[rng.randrange(len(parts))] = word()
        rows.append((10 + k, " ".join(parts)))
    rows += [(50, base[1]), (51, base[1].replace(" ", "\n\n")), (52, base[2] * 40), (53, base[2] * 40), (53, base[2] * 40), (54, base[3][:64])]
    return rows


# -- words ----------------------------------------------------------------------------------------------------


def test_shingle_sets_agree_with_sets_of_words():
    texts = [t for _, t in odd_rows()]
    column = pa.array(texts, pa.string()).slice(2, 20)
    got = list(words.shingle_sets(column, 3))
    want = []
    for t in texts[2:22]:
        parts = [w for w in SPACE.split((t or "").lower()) if w]
        want.append({tuple(parts[i:i + 3]) for i in range(max(1, len(parts) - 2))} if parts else set())
    assert [len(g) for g in got] == [len(w) for w in want]
    for a in range(len(want)):
        for b in range(a):
            assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


# -- 9: exact copies ------------------------------------------------------------------------------------------


def test_exact_groups(spark):
    rows = odd_rows()
    got = sorted(radix.exact_groups(documents(spark, rows), first_digit=4, growth=3).collect(), key=repr)
    plain = [(i, SPACE.sub(" ", t or "")) for i, t in rows]
    want, seen = [], set()
    for i, t in plain:
        ids = [j for j, u in plain if u == t]
        keep = None if None in ids else min(ids)  # a null id sorts first
        kept = i == keep and (i, t) not in seen
        seen.add((i, t))
        want.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    # which of two rows with equal id and text is kept is open
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_distinct_documents_keep_columns_and_one_of_each(spark):
    docs = documents(spark, odd_rows())
    got = radix.distinct_documents(docs)
    assert got.columns == docs.columns
    texts = [SPACE.sub(" ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub(" ", t or "") for _, t in odd_rows()})


def test_empty_tables(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert radix.exact_groups(none).count() == 0
    assert adaptjoin.similar_groups(none, 4, 85).count() == 0
    assert tiling.leaks(none, items).count() == 0
    assert tiling.leaks(documents(spark, [(1, "a b c d e f")]), items).count() == 0
    assert weak.scored(none, labels).count() == 0
    assert zlang.predicted(none, zlang.dictionaries(none)).count() == 0
    assert disclosure.report(disclosure.spans(none, disclosure.telling_terms(none))).count() == 0
    assert bpe.encoded(none, RANKS, public_tokenizers.PATTERN).count() == 0
    written = simple8b.write_ids(none, scratch_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    assert simple8b.read_ids(spark, written).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert markup.extracted(pages).count() == 0
    archive = fixity.write_archive(pages, scratch_path(spark, "none"))
    assert fixity.audit(fixity.leaves(archive), fixity.leaves(archive)).count() == 0


# -- 6: similar sets ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, percent", [(4, 85), (2, 60)])
def test_similar_groups(spark, n, percent):
    rows = [r for k, r in enumerate(odd_rows()) if r not in odd_rows()[:k]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in adaptjoin.similar_groups(documents(spark, rows), n, percent).collect()}
    sets = {}
    for i, t in rows:
        parts = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = {tuple(parts[k:k + n]) for k in range(max(1, len(parts) - n + 1))} if parts else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if None not in (a, b) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_prefixes_never_miss_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 200, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * rng.uniform(0.7, 1)))], rng.integers(0, 200, 3).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        counts = rng.integers(1, 50, 200).astype(float)
        (p, m, _), (q, k, _) = (adaptjoin.prefix(s, counts[s.astype(int)], 80, 1.0) for s in (a, b))
        asked = min(m, k)
        assert len(np.intersect1d(p[:len(p) - m + asked], q[:len(q) - k + asked])) >= asked


# -- 4: tiles -------------------------------------------------------------------------------------------------


def brute_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out.append((i, j, n))


def test_tiles_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(150):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 50))]
        hashed = [words.mix(np.array(x, dtype=np.uint64) + np.uint64(9)) for x in (a, b)]
        assert sorted(tiling.tile(*hashed, 3)) == sorted(brute_tiles(a, b, 3))


def test_leaks_find_reordered_passages(spark):
    first, second = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, f"{first} {second}"), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    docs = documents(spark, [
        (1, f"before {second.upper()}, between {first}! after"), (2, f"only half: {first.replace('zeta', 'ZETA')}"), (3, "alpha beta gamma delta"),
        (4, None), (5, ""), (6, "it is Too, short."), (None, f"{first} {second}"), (7, "word " * 30_000 + first + " " + second)])
    got = {(r.doc_id, r.item_id, round(r.coverage, 3), r.tiles) for r in tiling.leaks(docs, items).collect()}
    assert got == {(1, 1, 1.0, 2), (2, 1, 0.5, 1), (6, 2, 1.0, 1), (None, 1, 1.0, 1), (7, 1, 1.0, 1)}
    assert got == {(r.doc_id, r.item_id, round(r.coverage, 3), r.tiles) for r in tiling.leaks(docs, items, block_items=1).collect()}
    assert {r.doc_id for r in tiling.clean_documents(docs, items).collect()} == {3, 4, 5}


# -- 10: byte-level BPE ---------------------------------------------------------------------------------------


def test_transducer_gives_the_ids_of_the_library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks), random.Random(2)
    letters = "ab  \n\t é日本語x1²½'s'll😀́ÿЖ0-_=<>\"{}();,.:?!#\x85 " + "etaoinshr" * 2
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, "".join(rng.choice("etaoinshrdlu") for _ in range(5000)), "", " ", "  x", "x  ", "<|endoftext|>"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode_ordinary(t), t
        assert b"".join(decoder.pieces(ids, 3)).decode() == t


def test_encoded_rows(spark):
    rows = [(1, None), (2, ""), (None, "Grüße 😀"), (3, "x y"), (3, "x y")]
    got = {r.doc_id: r for r in bpe.encoded(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (0, empty, empty)
    assert got[None].decoded_sha256 == hashlib.sha256("Grüße 😀".encode()).hexdigest()


def test_each_piece_of_a_block_is_encoded_once():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    words_ = [f"{a}{b}" for a in "Bcdfg" for b in ("oma", "illo", "uste", "\u00e9ra", "en")]
    texts = [None, *(f"{a}{mark}{b} {a}" for a in words_ for b in words_ for mark in (".\n", ", ", "/", "-&&& ", "\t", "\u3002 ")), ""]
    for pattern in (public_tokenizers.PATTERN, r" ?\w+(?:'\w+)?|[^\w\s]+\w*|\s+"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encoder, read = bpe.Encoder(ranks, pattern), []
        encode = encoder.transducer.encode
        encoder.transducer.encode = lambda data: read.append(data) or encode(data)
        got = [ids[a:b].tolist() for ids, places, *_ in encoder.blocks(pa.array(texts)) for a, b in zip(places[:-1], places[1:])]
        assert got == [library.encode_ordinary(t or "") for t in texts]
        if pattern == public_tokenizers.PATTERN:
            assert max(map(read.count, read)) <= 2  # as a piece, and as a word of longer pieces
            assert len(encoder._pieces.pieces) <= 8 * len(words_)  # not the number of pairs


def test_memories_that_run_over_change_no_ids():
    import random

    with open(RANKS, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("etaoinshr'\u00e9\u4e2d1.", k=rng.randint(0, 9))) for _ in range(40)) for _ in range(60)]
    texts += ["ab" * 2000 + " " + "aaab" * 700, "x" * 1025, "y" * 1024]
    wide, narrow = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Encoder(ranks, public_tokenizers.PATTERN, 50, 20)
    for t in texts:
        assert narrow.encode(t).tolist() == wide.encode(t).tolist()
    assert len(narrow._pieces.pieces) <= 2 * 60


def test_utf8_machine_refuses_what_is_not_utf8():
    for bad in (b"\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", b"\xe2\x28"):
        with pytest.raises(ValueError):
            bpe.Utf8Machine().feed(bad)


# -- 7: token files -------------------------------------------------------------------------------------------


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 300))
        bits = rng.integers(0, 65, n)
        ids = np.array([(1 << int(b)) - 1 - int(rng.integers(0, 2)) * int(b > 1) for b in bits], dtype=np.uint64)
        assert (simple8b.unpack(simple8b.pack(ids), n) == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(5, "later words, é!"), (1, None), (2, ""), (None, "no id"), (3, "<|endoftext|> a  b\n"), (3, "again"), (4, "long " * 9000), (6, "hello <|endoftext|> x"), (7, "a<|endoftext|><|endoftext|>b <|endof text|>")]
    files = simple8b.write_ids(documents(spark, rows), scratch_path(spark, "ids"), path, file_chars=1 << 14)
    got = simple8b.read_ids(spark, files, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts = [t or "" for i, t in rows if i == r.doc_id]
        assert r.ids in [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    assert [r.ids for r in got if r.doc_id == 6] == [[31373, 220, 50256, 2124, 0]]


def _tokens(limit: int = 1000):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return simple8b._Tokens(f.read(), limit)


def test_ids_of_pieces_are_those_of_whole_texts():
    import random

    import pyarrow as pa

    rng, tokens = random.Random(5), _tokens(200)
    parts = list("ab Z's  \n\t\r\x0b\x0c'.,;-$3\u0663\u00bd\u00e9\u00d7\u00c0\u00df\ufb01\u0414\u4e2d\u3042 \u0085\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000"
                 "\ufeff\u2014\u201d\U0001f600e\u0301\x00\x1c\x1f\x7f") + ["'s", "'re", " the", "don't", "\n\n", "  ", "<|endoftext|>", "<|endof", " a.b", "!?"]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    got = list(tokens.encode(pa.array(texts)))
    assert [g.tolist() for g in got] == [tokens.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in tokens.encode(pa.array([None, ""], pa.string()))] == [[], []]
    assert list(tokens.encode(pa.array([], pa.string()))) == []


def test_words_side_by_side_are_learnt_once():
    import pyarrow as pa

    words_ = [f"{a}{b}" for a in "Bcdfg" for b in ("oma", "illo", "uste", "\u00e9ra", "en")]
    tokens = _tokens()
    texts = [f"{a}{mark}{b}" for a in words_ for b in words_ for mark in (".\n", ", ", "/", "-&&& ")]
    assert len(list(tokens.encode(pa.array(texts)))) == len(texts)
    assert len(tokens.kept.pieces) <= 4 * len(words_)  # not the number of pairs


def test_kept_pieces_stay_few():
    import pyarrow as pa

    tokens = _tokens(100)
    for k in range(50):
        texts = ["the same " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for i in range(26))]
        got = [g.tolist() for g in tokens.encode(pa.array(texts))]
        assert got == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tokens.kept.pieces) == len(tokens.kept.sizes) == len(tokens.kept.asked) <= 2 * 100 + 30
        assert len(tokens.kept.ids) == tokens.kept.sizes.sum()
    assert {b"the", b" same"} <= set(tokens.kept.pieces.to_pylist())  # what is in use stays
    texts = ["x" * 20_000, "the same", "the same", "y" * 20_000]  # long pieces do not
    assert [g.tolist() for g in tokens.encode(pa.array(texts))] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.kept.pieces.nbytes < 20_000 and len(tokens.kept.pieces) == len(tokens.kept.sizes) == len(tokens.kept.asked)


def test_writing_ids_leaves_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = [(k, f"text {k}") for k in range(3)]
    simple8b.write_ids(documents(spark, rows), scratch_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    assert spark.conf.get(key) == before


def test_a_definition_that_cuts_elsewhere_goes_to_the_library_whole():
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        parts = json.load(f)
    parts["pre_tokenizer"]["add_prefix_space"] = True
    definition, texts = json.dumps(parts), ["hello world.\nagain", " x", ""]
    want = [Tokenizer.from_str(definition).encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in simple8b._Tokens(definition).encode(pa.array(texts))] == want


# -- 5: pages -------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><div id=top class='site-header'>Hi</div>
    <nav><ul><li><a href=/>home</a></ul></nav><div class=content><h2>T &amp; U</h2><p>Long   text here that is
    content, yes really it is.<p>Second <b>para</b> more &eacute; text.<ul><li>one<li>two</ul><aside>no</aside>
    <script>var p = "</p>";</script><div class='comments'>c1<p>c2</div></div><form>x<input></form><div class=sidebar>side</div>
    <footer>(c)</footer></body></html>"""
    article = "<div class=ad>Buy a great many things here, all day long.<article><h1>A</h1><p>x</article><p>after"
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "plain"), (4, "w", article), (4, "w", article), (5, "z", "<p>" + "y " * 90_000)]
    got = {r.page_id: r for r in markup.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "T & U\nLong text here that is content, yes really it is.\nSecond para more é text.\none\ntwo"
    assert [got[k].text for k in (2, None, 3, 4)] == ["", "", "plain", "A\nx"]
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[5].n_chars == 179_999


def test_no_part_of_a_text_is_left_out():
    long, short = "long words of content that go on for a while and on " * 6, "fewer words of content here " * 5
    frame = "<html><body><nav>menu</nav>{}</body></html>"
    for parts in ("<div><p>{0}</div><div><p>{1}</div>", "<section><p>{0}</section><section><p>{1}</section>",
                  "<div><p>{1}<ul><li>{0}<li>{0}</ul></div>", "<div><p>{1}<table><tr><td>{0}</table></div>",
                  "<div><p>{1}<blockquote>{0}</blockquote></div>", "<article><p>{0}</article><article><p>{1}</article>"):
        got = markup.main_text(frame.format(parts.format(*[f"<b>{x}</b>" if x == short and "div" in parts and "<ul" in parts else x for x in (long, short)])))
        assert long.strip() in got and short.strip() in got and "menu" not in got, parts


def test_a_class_hides_only_what_is_no_content():
    text = "words of the content that are many and go on " * 3
    side = "<div class='sidebar'><p>side words</p></div>"
    for name in ("content no-sidebar", "article-with-sidebar", "page-banner-layout", "has-sidebar", "search"):
        assert "side words" not in (got := markup.main_text(f"<body><div class='{name}'><p>{text}<p>{text}{'' if name == 'search' else side}</div></body>")) and text.strip() in got, name
    assert markup.main_text(f"<body><div><p>{text}<p>x <span class=ad>buy</span> y</div><div class='comments'><p>{text * 9}</div></body>").endswith("x y")


def test_ratios_decide_beside_a_teaser_in_an_article():
    text = [f"paragraph {k} of the content, whose words are many and go on for a while, so that its ratio is high" for k in range(6)]
    teaser = "<article><ul>" + "<li><a href=/><b><i>x</i></b></a>" * 8 + "</ul></article>"
    got = markup.main_text(f"<body>{teaser}<div>{''.join(f'<p>{t}</p>' for t in text)}</div></body>")
    assert all(t in got for t in text)
    plain = "".join(f"<p>{t}</p>" for t in text)
    assert markup.main_text(f"<body><div>{plain}</div><div><p>short</p></div><article>{plain}</article></body>") == "\n".join(text)


# -- 2: personal data -----------------------------------------------------------------------------------------


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and disclosure.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], disclosure.KINDS.index(s[2])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for letters in ("ab@.-1 ", "0123.", "0 -19", "+1 ().-2", "a@b.c1+5 é٣"):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
            assert disclosure.base_spans(t) == brute_spans(t), t


def test_telling_terms(spark):
    near = [(k, f"see zorblat at 10.0.0.{k % 200} now common word {k}") for k in range(40)]
    far = [(100 + k, "common word see now at rest") for k in range(200)]
    copies = [(400 + k, "quuxle writes to me@here.org") for k in range(20)]
    docs = documents(spark, near + far + copies + [(None, None), (900, ""), (901, "zorblat alone é zorblat")])
    terms = disclosure.telling_terms(docs, generalise=0.5)
    found = {r.doc_id: r for r in disclosure.report(disclosure.spans(docs, terms)).collect()}
    assert found[3].spans == "term:4:11,ip:15:23" and found[3].n_ip == 1 and found[3].n_terms == 1
    assert found[901].spans == "term:0:7,term:16:23"
    assert found[400].spans == "email:17:28"  # words that stand near one address only tell nothing
    assert found[None].spans == found[900].spans == "" and found[None].base_sha256 == hashlib.sha256(b"").hexdigest()
    rows = disclosure.spans(docs, terms).collect()
    assert len(rows) == docs.count()
    assert disclosure.sanitised("see zorblat at 10.0.0.3", [(4, 11, "term", "removed"), (15, 23, "ip", "generalised")]) == "see  at [IP]"


def test_every_entity_near_a_term_counts(spark):
    rows = [(k, f"zorblat all@here.org {'filler ' * 20} zorblat own{k}@there.org") for k in range(6)]
    rows += [(100 + k, "some other words at rest") for k in range(60)]
    got = disclosure.telling_terms(documents(spark, rows)).collect()
    term = {r.near_docs for r in got if r.kind == "email"}
    assert len(got) >= 1 and term == {6}  # once per document, though near two addresses each


# -- 3: language ----------------------------------------------------------------------------------------------


def test_language_by_compression(spark):
    rng = random.Random(4)
    syllables = {"aa": "ka ro mi tu na so le vi".split(), "bb": "sch ung ein ber keit ver aus ich".split(), "cc": "eau oux ille ent oir que é ai".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(k, text(lang, rng.randint(20, 120)), lang) for k in range(300) for lang in ("aa", "bb", "cc")]
    rows = [(3 * k + "aabbcc".index(lang) // 2, t, lang) for k, (_, t, lang) in enumerate(rows)]
    learn = spark.createDataFrame(rows[:600], "doc_id long, text string, lang string")
    odd = [(-1, None, None), (-2, "", "aa"), (-3, "123 !", "aa"), (None, text("bb", 30), None)]
    rest = spark.createDataFrame(rows[600:] + odd, "doc_id long, text string, lang string")
    contents = zlang.dictionaries(learn)
    assert sorted(contents) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in zlang.predicted(rest, contents).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang in rows[600:])
    assert right / 300 > 0.97 and got[None].lang_pred == "bb"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (-1, -2, -3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert zlang.verdict(["aa", "bb"], [100.0, 100.5], 0.01)[0::2] == ("aa", True)


# -- 1: toxicity ----------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["zogwort" + e for e in ("a", "en", "ish", "er")] + ["idiot", "scum"]
    rows, labels = [], []
    for k in range(900):
        parts, toxic = [rng.choice(plain) for _ in range(rng.randint(5, 60))], int(k % 6 == 0)
        if toxic:
            parts += rng.sample(bad, 2)
            rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
        if k < 700:
            labels.append((k, toxic))
    rows += [(None, "zogworta scum"), (2000, None), (2001, ""), (2001, "")]
    labels += [(None, 1), (5, None), (9999, 1)]
    docs, table = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = weak.scored(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.doc_id is not None and 700 <= r.doc_id < 900]
    assert sum(p == t for p, t in held) >= 196
    assert {r.predicted for r in got if r.doc_id in (2000, 2001)} == {0}
    alone = {r.doc_id: r.predicted for r in weak.scored(documents(spark, [(1, "you idiot"), (2, "good day")]), table.limit(0)).collect()}
    assert alone == {1: 1, 2: 0}


def test_shouting_is_that_of_the_whole_text():
    mined = weak.Mined([], [])
    quiet, loud = "quiet words of a text " * 20, "LOUD WORDS OF A TEXT " * 60
    bit = 1 << (weak.LEXICONS + 3)
    assert weak.votes(quiet + loud, set(), [], mined) & bit  # only after the first 400 characters
    assert not weak.votes(loud[:450] + quiet * 9, set(), [], mined) & bit  # only in a heading


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.2
    votes = np.stack([np.where(y, rng.random(n) < hit, rng.random(n) < false) for hit, false in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.1), (0.5, 0.2))], axis=1)
    votes = np.concatenate([votes, votes[:, 3:]], axis=1)  # a voter that only repeats another
    votes[rng.random(n) < 0.05, 4] ^= True
    patterns = (votes * (1 << np.arange(5))).sum(axis=1)
    known = np.where(rng.random(n) < 0.05, y, -1)
    masks, inverse = np.unique(np.stack([patterns, known], axis=1), axis=0, return_inverse=True)
    model = weak.LabelModel(5).fit(masks[:, 0], masks[:, 1], np.bincount(inverse.ravel()).astype(float))
    assert (3, 4) in {tuple(sorted(e)) for e in model.order}
    assert abs(model.prior - 0.2) < 0.03
    assert np.mean((model.posterior(patterns) > 0.5) == y) > 0.93


# -- 8: archives ----------------------------------------------------------------------------------------------


def test_fixity_audit(spark):
    rows = [(k, f"http://h/{k}", f"<p>page {k}</p>" * (k % 7)) for k in range(200)] + [(None, None, None), (7, "http://h/7", "<p>again</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    ours = fixity.write_archive(pages, scratch_path(spark, "archive"))
    records = fixity.leaves(ours)
    assert records.count() == len(rows) and records.filter("not sound").count() == 0

    def change(page_id, record):
        if page_id == 40:
            return record[:-5] + bytes([record[-5] ^ 1]) + record[-4:]
        return record

    same = fixity.leaves(fixity.replicate(ours, scratch_path(spark, "same")))
    assert fixity.audit(records, same, fanout=3).count() == 0
    theirs = fixity.leaves(fixity.replicate(ours, scratch_path(spark, "theirs"), change))
    got = fixity.audit(records, theirs, fanout=3).collect()
    assert [(r.page_id, r.problem, r.damaged) for r in got] == [(40, "changed", "theirs")]
    last = records.groupBy("file").max("number").toDF("file", "number")
    short = records.join(last, ["file", "number"], "left_anti")
    assert {r.problem for r in fixity.audit(records, short, fanout=3).collect()} == {"missing"}
    assert fixity.audit(records, short, fanout=3).count() == last.count()


def test_records_are_read_as_written(tmp_path):
    file = fixity._File(tmp_path.as_uri(), "x.warc.gz")
    texts = [b"", b"a\r\n\r\nb", b"z" * 3_000_000]
    for k, t in enumerate(texts):
        file.add(fixity.record(k, "u", t))
    file.close()
    got = list(fixity.read_records(os.path.join(tmp_path.as_uri(), "x.warc.gz")))
    assert [fixity.payload_of(w, f) for _, f, w in got] == texts and [o for o, _, _ in got][1] == len(got[0][2])


def packed_pages(folder, n=40):
    """Stored records of a file, and that file as a table row for `leaves`."""
    return [fixity.packed(fixity.record(k, f"http://h/{k}", f"<p>page {k} {k * k}</p>".encode() * (1 + k % 7))) for k in range(n)]


def file_table(spark, folder, stored):
    os.makedirs(folder, exist_ok=True)
    (folder / "x.warc.gz").write_bytes(b"".join(stored))
    return spark.createDataFrame([("x.warc.gz", f"{folder.as_uri()}/x.warc.gz")], "file string, path string")


def test_every_flipped_bit_of_a_stored_member_is_located(tmp_path):
    stored = packed_pages(tmp_path, 3)
    whole = b"".join(stored)
    a, b = len(stored[0]), len(stored[0]) + len(stored[1])
    path = tmp_path / "x.warc.gz"
    for at in range(a, b):
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 1 << at % 8]) + whole[at + 1:])
        got = list(fixity.read_members(path.as_uri()))
        assert [(o, o + len(s)) for o, s, _ in got] == [(0, a), (a, b), (b, len(whole))], at
        assert got[1][1] != stored[1] and got[0][1] == stored[0] and got[2][1] == stored[2]
    path.write_bytes(whole[:-5])
    assert [w is None for _, _, w in fixity.read_members(path.as_uri())] == [False, False, True]


def test_damage_in_the_stored_file(spark, tmp_path):
    stored = packed_pages(tmp_path)
    ours = fixity.leaves(file_table(spark, tmp_path / "a", stored))
    start = [sum(map(len, stored[:k])) for k in range(41)]

    def found(theirs):
        got = fixity.audit(ours, fixity.leaves(file_table(spark, tmp_path / str(len(os.listdir(tmp_path))), theirs)), fanout=3).collect()
        return sorted((r.number, r.page_id, r.problem, r.damaged, r.start, r.end) for r in got)

    def flip(k, at):
        return stored[k][:at] + bytes([stored[k][at] ^ 4]) + stored[k][at + 1:]

    bad = {k: flip(k, at) for k, at in ((0, 0), (9, len(stored[9]) // 2), (20, -3), (39, 11))}
    assert found([bad.get(k, s) for k, s in enumerate(stored)]) == [(k, k, "changed", "theirs", start[k], start[k + 1]) for k in sorted(bad)]
    lost = [bad.get(k, s) for k, s in enumerate(stored) if k not in (5, 17)]
    assert found(lost) == sorted([(k, k, "changed", "theirs", start[k], start[k + 1]) for k in bad] +
                                 [(k, k, "missing", None, start[k], start[k + 1]) for k in (5, 17)])
    more = stored[:12] + [stored[3]] + stored[12:]  # a record that stands twice
    assert [(r[1], r[2]) for r in found(more)] == [(3, "extra")]
