import random
import re

from citeloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute(text):
    """The rules as written, with plain regular expressions."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_rules_equal_plain_regular_expressions():
    draw = random.Random(7)
    parts = ["a@b.co", "a@b@c.de", "x_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (612) 555-4887", "+12", "++49 30 1234567", " ", "ü@ü.de", "@", ".", "-", "0001.2.3.004", "é", "+", "9" * 18, "a.b+c%d@x-y.z-w.q", "\n", "(", ")"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text
    for _ in range(4000):
        text = "".join(draw.choice("+(1.2@- a4") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans(None) == [] == pii.base_spans("")


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1 " * 150_000, "+1" + "(" * 300_000, "@" * 300_000):
        base = pii.base_spans(text)
        list(pii.instances(text, base))


def test_instances_never_overlap_spans():
    text = "mail a@b.co or tel 030-1234567, card 4111 1111 1111 1111 and x1y (at 10.0.0.1:80)"
    base = pii.base_spans(text)
    spots = list(pii.instances(text, base))
    assert [text[a:b] for k, _, a, b, *_ in spots if k is None] == ["030-1234567", "x1y", "80"]
    assert [s[0] for s in spots if s[0]] == ["email", "ip", "card"] or len([s for s in spots if s[0]]) == 3


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, __id long, more string")


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"lorem call hotline +49 30 12345{i:02d}{i % 7} today word{i}", i, "x") for i in range(12)]
    rows += [(100, "please call hotline 030-5551234 today again", 1, None), (101, "version 030-5551299 is out", 1, None), (102, None, 1, None), (103, "", 1, None), (None, "call hotline +49 30 1234567 today", 1, None), (None, "call hotline +49 30 1234567 today", 1, None)]
    got = {}
    for r in pii.spans(_docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[100][0].base == "" and got[100][0].spans == "phone:20:31" and got[100][0].n_phone == 0
    assert got[101][0].spans == "" and got[102][0].spans == "" and got[103][0].spans == ""
    assert len(got[None]) == 2 and {r.spans for r in got[None]} == {"phone:13:27"}
    assert got[0][0].n_phone == 1 and got[0][0].n_email == got[0][0].n_ip == got[0][0].n_card == 0
    assert sum(map(len, got.values())) == len(rows)


def test_one_confident_pattern_is_enough(spark):
    rows = [(i, f"w{'abcdefghijkl'[i]} call hotline: +49 30 12345{i:02d}{i % 7} {'abcdefghijkl'[i]}w", i, "x") for i in range(12)]
    # the words around vary: only some of the patterns have seeds
    rows += [(100, "other call hotline: 030-5551234 elsewhere", 1, None), (101, "new hotline: 030-5551235 there", 1, None), (102, "room 030-5551236 there", 1, None)]
    # accepted instances make a pattern speak that has no seeds of the rules
    rows += [(200 + i, f"call hotline: 030-66600{i:02d} office", 1, None) for i in range(6)] + [(210 + i, f"call hotline: 030-66600{i:02d}, fax 030-66600{i:02d}", 1, None) for i in range(6)] + [(300, "fax 030-7770001 too", 1, None)]
    got = {r.doc_id: r.spans for r in pii.spans(_docs(spark, rows)).collect()}
    assert got[100] == "phone:20:31" and got[101] == "phone:13:24" and got[102] == ""
    assert got[300] == "phone:4:15"


def test_redact_keeps_columns_and_nulls(spark):
    rows = [(1, "mail a@b.co, ip 10.0.0.1", 5, "m"), (2, None, 6, None), (2, None, 6, None), (3, "", 7, "z")]
    out = pii.redact(_docs(spark, rows))
    assert out.columns == ["doc_id", "text", "__id", "more"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "mail [EMAIL], ip [IP]", 5, "m"), (2, None, 6, None), (2, None, 6, None), (3, "", 7, "z")], key=str)
    assert pii.spans(_docs(spark, [])).count() == 0 == pii.redact(_docs(spark, [])).count()


def plain_discovery(rows, rounds=3, min_seeds=5, accept=0.75):
    """The same rounds over dictionaries: (row, kind, start, end) of instances that are accepted."""
    edges, spots = set(), []
    for n, text in enumerate(rows):
        for kind, fits, a, b, value, patterns in pii.instances(text, pii.base_spans(text)):
            spots.append((n, kind, a, b, value))
            edges |= {(p, value, kind, tuple(fits)) for p in patterns}
    size, seeds, unseen = {}, {}, set()
    for p, value, kind, fits in edges:
        size.setdefault(p, set()).add(value)
        if kind:
            seeds.setdefault((p, kind), set()).add(value)
        else:
            unseen |= {(p, value, k) for k in fits}
    scores = {}
    for _ in range(rounds):
        confidence = {}
        for key in {(p, k) for p, _, k in unseen}:
            of = [scores[v, k] for p, v, k in unseen if (p, k) == key and (v, k) in scores]
            known = len(seeds.get(key, ()))
            if known + sum(s >= accept for s in of) >= min_seeds:
                confidence[key] = (known + sum(1.0 if s >= accept else s for s in of)) / (len(size[key[0]]) + 1)
        scores = {}
        for p, v, k in unseen:
            if (p, k) in confidence:
                scores[v, k] = max(scores.get((v, k), 0.0), confidence[p, k])
    best = {}
    for (v, k), s in scores.items():
        if s >= accept:
            best[v] = max(best.get(v, (0.0, "")), (s, k))
    return {(n, best[v][1], a, b) for n, kind, a, b, v in spots if not kind and v in best}


def test_discovery_equals_plain_rounds(spark):
    draw = random.Random(2)
    cue = {"phone": ("call", "hotline"), "card": ("card", "number"), "ip": ("host", "at"), "email": ("write", "to")}
    good = {"phone": lambda: f"+49 30 {draw.randrange(10**6, 10**7)}", "card": lambda: "4111 1111 1111 1111", "ip": lambda: f"10.0.{draw.randrange(256)}.7", "email": lambda: f"u{draw.randrange(999)}@x.org"}
    odd = {"phone": lambda: f"030-{draw.randrange(10**6, 10**7)}", "card": lambda: f"4111-1111-1111-{draw.randrange(1000, 9999)}", "ip": lambda: f"10.0.{draw.randrange(256, 999)}.7", "email": lambda: f"u{draw.randrange(999)}@host"}
    rows = []
    for _ in range(150):
        kind = draw.choice(list(cue))
        rows.append(" ".join([draw.choice(["so", "then", "w" * 90 + "1"]), *cue[kind], draw.choice([good, good, odd])[kind](), draw.choice(["now", "today", ""]), draw.choice(["", str(draw.randrange(9999))])]))
    docs = _docs(spark, [(i, t, 1, None) for i, t in enumerate(rows)])
    got = {(r.doc_id, r.kind, r.start, r.stop) for r in pii.discover(pii.scan(docs)).collect()}
    assert got == plain_discovery(rows) and len({k for _, k, _, _ in got}) >= 3


def test_long_identifiers_and_words_are_whole():
    name = "x1" * 400
    text = f"{'y' * 900}a {name}@host rest"
    (seed, fits, a, b, value, patterns), = pii.instances(text, [])
    assert text[a:b] == f"{name}@host" and fits == ["email"] and value[0] == "#"
    other = list(pii.instances(text.replace("ya ", "yb "), []))[0]
    assert other[4] == value and other[5] != patterns  # the words differ in their last letter only


def test_hidden_identifiers_are_discovered_where_contexts_tell(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    cues = {"phone": ["call hotline", "ring desk", "fax number"], "card": ["card number", "charged to"], "ip": ["host at", "address is"], "email": ["write to", "reply via"]}

    def card():
        digits = "4" + "".join(str(draw.randrange(10)) for _ in range(14))
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    make = {"phone": lambda: f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}", "card": card, "ip": lambda: ".".join(str(draw.randrange(1, 255)) for _ in range(4)), "email": lambda: f"{word()}@{word()}.org"}
    told, random_words = [], []
    for i in range(600):
        kind = draw.choice(list(make))
        noise = [word() for _ in range(30)]
        at = draw.randrange(30)
        told.append((i, " ".join([*noise[:at], draw.choice(cues[kind]), make[kind](), *noise[at:]]), 1, None))
        random_words.append((i, " ".join([*noise[:at], make[kind](), *noise[at:]]), 1, None))
    got = {r.kind: r for r in pii.held_out(_docs(spark, told)).collect()}
    assert set(got) == set(make)
    for r in got.values():  # n is about a fifth of 150
        assert r.n >= 15 and r.found / r.n >= 0.9 and r.other == 0, r
    assert all(r.found == 0 == r.other for r in pii.held_out(_docs(spark, random_words)).collect())
    assert pii.held_out(_docs(spark, [(1, None, 1, None), (2, "", 1, None)])).count() == 0 == pii.held_out(_docs(spark, [])).count()
