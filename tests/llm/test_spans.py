import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import pii, secrets
from quarrymill.llm.automata import Automaton, infer
from quarrymill.llm.spans import covered, joined, outside, replaced


def luhn(s):
    total = 0
    for i, c in enumerate(s[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_pii(text):
    found = []
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for n, (kind, rule) in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), n, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]


def brute_secrets(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = [("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)]
    found = [(m.start(), n, m.end(), kind) for n, (kind, rule, least) in enumerate(rules) for m in re.finditer(rule, text) if len(m.group(2) if kind == "assign" else m.group()) >= least]
    return [(k, a, b) for a, _, b, k in sorted(found)]


PIII = st.lists(st.sampled_from(["a", "b.c", "@", "-", ".", " ", "+", "(", ")", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "é", "١", "a@b.co", "+1 (415) 555-0100", "10.0.0.1", "\n", "_%"]), max_size=14).map("".join)
SECRET = st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "ſecret", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "x", "é", "_", "/+"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIII)
def test_pii_base_rules(text):
    assert pii.base_spans(text) == brute_pii(text)


@settings(max_examples=400, deadline=None)
@given(SECRET)
def test_secret_base_rules(text):
    assert [s for s, _ in secrets.base_spans(text)] == brute_secrets(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 100_000, "@" * 100_000, "a@" * 100_000, "password" * 20_000, "[at]" * 50_000, "1 " * 100_000, "A1" * 100_000, "+1" + "(" * 100_000])
def test_linear_time(text):
    began = time.time()
    pii.candidates(text, pii.base_spans(text))
    secrets.candidates(text, [s for s, _ in secrets.base_spans(text)])
    assert time.time() - began < 8


def test_pii_of_odd_documents(odd, none):
    model = pii.fit(odd)
    rows = pii.find(odd, model).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.where("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            base = brute_pii(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
            assert set(joined(base).split(",")) <= set(r["spans"].split(",")) | {""}
    assert pii.find(none, pii.fit(none)).collect() == []


def test_weak_supervision_adds_spans(spark):
    texts = [f"please write to me, mail: user{i} [at] example [dot] com today" for i in range(40)]
    texts += [f"call phone 415-555-01{i:02d} now" for i in range(40)] + [f"order no 1234-5678-9012-{i:04d} is a number" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(docs)
    assert len(model.reliability) == pii.N_VOTES and all(0.5 < r < 1 for r in model.reliability)
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs, model).collect()}
    assert all(rows[i].startswith("email:") for i in range(40)) and all(rows[i].startswith("phone:") for i in range(40, 80))
    assert sum(bool(rows[i]) for i in range(80, 120)) <= 4


def test_redaction():
    assert replaced("ab cd ef", [("x", 3, 5), ("y", 4, 8)]) == "ab [X]"
    assert replaced("", []) == ""


def test_secrets_of_odd_documents(odd, none):
    model = secrets.fit(odd)
    rows = secrets.find(odd, model).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.where("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["base_sha256"] == hashlib.sha256(joined(brute_secrets(texts[r["doc_id"]])).encode()).hexdigest()
    assert len(rows) == odd.count() and secrets.find(none, secrets.fit(none)).collect() == []


def test_automata_learn_formats():

    random.seed(1)
    keys = ["AKIA" + "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(200)]
    other = ["".join(random.choices("0123456789", k=14)) for _ in range(200)]
    a, b = infer(keys[50:]), infer(other)
    assert len(a.arrivals) < 60
    gain = lambda t: (a.log_likelihood(t) - b.log_likelihood(t)) / (len(t) + 1)
    assert min(map(gain, keys[:50])) > 0.35 > max(map(gain, other))
    assert infer([]).log_likelihood("abc") < 0


def test_grammar_adds_spans(spark):

    random.seed(2)
    token = lambda: "zq_" + "".join(random.choices("abcdefghijkmnpqrstuvwxyz23456789", k=24))
    texts = [f"here token = {token()} stands" for _ in range(120)] + [f"seen in the log {random.randrange(10**14, 10**15)} at noon" for i in range(120)]
    hidden = token()
    texts.append(f"it was {hidden} once")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in secrets.find(docs, secrets.fit(docs)).collect()}
    assert rows[240] == f"assign:7:{7 + len(hidden)}"
    assert not any(rows[i] for i in range(120, 240))


@pytest.mark.parametrize("few", [1, 3, 9])
def test_a_grammar_is_inferred_from_few_credentials(spark, few):
    random.seed(few)
    form = lambda: "".join(random.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=28))
    plain = ["the quick brown foxes jumped over seventeen lazy documents", "reference 8812734 of the extraordinary catalogue, section nineteen"]
    rows = [(i, f"password = {form()} and so on") for i in range(few)] + [(100 + i, plain[i % 2]) for i in range(60)]
    hidden = form()
    docs = spark.createDataFrame([*rows, (500, f"it was {hidden} once")], "doc_id long, text string")
    model = secrets.fit(docs)
    assert list(model.kinds) == ["assign"]
    got = {r["doc_id"]: r["spans"] for r in secrets.find(docs, model).collect()}
    assert not any(got[i] for i in range(100, 160))
    if few > 1:
        assert got[500] == f"assign:7:{7 + len(hidden)}"


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("it was zq_abc2defghjk3mnpqrstuv9.", ["zq_abc2defghjk3mnpqrstuv9"]),
        ("auth=zq_abc2defghjk3mnpqrstuv9 once", ["zq_abc2defghjk3mnpqrstuv9"]),
        ("key:abc2defghjk3mn==, b64", ["abc2defghjk3mn=="]),
        ("see eyJhbGciOi.eyJzdWIi0.SflKxwRJ_x here", ["eyJhbGciOi.eyJzdWIi0.SflKxwRJ_x"]),
        ("x " + "a1" * 100 + " y", ["a1" * 100]),
        ("nodigitsatall", ["nodigitsatall"]),
        ("first.lastname1@hostname.example", []),
    ],
)
def test_candidates_are_whole_tokens(text, tokens):
    assert [t for _, _, t in secrets.candidates(text, [])] == tokens


def test_grammar_adds_a_token_at_the_end_of_a_sentence_and_after_a_sign(spark):

    random.seed(3)
    form = lambda: "zq_" + "".join(random.choices("abcdefghjkmnpqrstuv23456789", k=22))
    rows = [(i, f"password = {form()} and so on") for i in range(120)]
    rows += [(120 + i, "reference number " + "".join(random.choices("0123456789", k=14)) + " of the extraordinary catalogue") for i in range(120)]
    hidden = form()
    rows += [(240, f"It was {hidden}."), (241, f"auth={hidden} once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find(docs, secrets.fit(docs)).collect()}
    assert got[240] == f"assign:7:{7 + len(hidden)}" and got[241] == f"assign:5:{5 + len(hidden)}"
    assert not any(got[i] for i in range(120, 240))


@pytest.mark.parametrize("unit", ["a@b.co 12-345-6789 ", "token=abcdefgh1 zq8abc2defghjk ", "user (at) host dot com, 415-555-0100; ", "10.0.0.1 4111111111111111 +14155550100 "])
def test_linear_time_with_many_spans(unit):
    def seconds(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        pii.candidates(text, pii.base_spans(text))
        secrets.candidates(text, [s for s, _ in secrets.base_spans(text)])
        return time.process_time() - began

    assert seconds(1_000_000) < 15 and seconds(1_000_000) < 30 * seconds(100_000) + 1


INTERVALS = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)).map(lambda x: ("k", x[0], x[0] + x[1])), max_size=12)


@given(INTERVALS, INTERVALS)
def test_outside_is_that_of_all_pairs(spans, taken):
    spans = sorted(spans, key=lambda s: s[1])
    assert outside(spans, covered(taken)) == [s for s in spans if all(s[2] <= a or s[1] >= b for _, a, b in taken)]


def test_expectation_maximisation_row_by_row(spark):
    """The same estimates from every candidate by itself, in plain Python."""
    texts = [f"please write to me, mail: user{i} [at] example [dot] com today" for i in range(9)] + ["see 12-345-6789 or page 415-555-0100", "card 4111-1111-1111-1112 order no 1234-5678-9012-3456"] * 3
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rounds=7)
    votes = [v for t in texts for _, v, _ in pii.candidates(t, pii.base_spans(t))]
    right, prior, n = [0.7] * pii.N_VOTES, 0.3, len(votes)
    for _ in range(7):
        p = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right, strict=True))
            p.append(1 / (1 + math.exp(-odds)))
        strength = 0.1 * n + 10
        for j in range(pii.N_VOTES):
            agreed = sum(q if v[j] > 0 else 1 - q for v, q in zip(votes, p, strict=True) if v[j])
            right[j] = min(0.99, max(0.55, (agreed + 0.7 * strength) / (sum(v[j] != 0 for v in votes) + strength)))
        prior = min(0.9, max(0.05, (sum(p) + 3) / (n + 10)))
    assert model.reliability == pytest.approx(right) and model.prior == pytest.approx(prior)


def test_words_around_a_span_decide_where_all_labelers_abstain(spark):
    """"dial" is in no gazetteer and "batch" in no list against; they are learned from candidates that have votes."""
    texts = [f"by phone you may dial 77/345/68{i:02d} today" for i in range(60)] + [f"order no 1234-5678-9012-{i:04d} is a number" for i in range(60)]
    texts += [f"the order no of the batch 12-345-6{i:02d} today" for i in range(60)]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    good, bad = "then you may dial 77/345/688 today", "it is of the batch 77/345/688 today"
    for text in (good, bad):
        ((_, votes, columns),) = pii.candidates(text, [])
        assert not any(votes) and columns == tuple(sorted(set(columns))) and columns[-1] < pii.WIDTH
    assert [len(model.spans(t)[1]) for t in (good, bad)] == [1, 0]


def test_counts_of_candidates_are_those_of_each_text(spark):
    texts = ["call 415-555-0100 or 415-555-0101", "call 415-555-0102", None, "", "mail: me [at] host [dot] org"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = {}
    for t in texts:
        for _, votes, columns in pii.candidates(t or "", []):
            counted[votes, columns] = counted.get((votes, columns), 0) + 1
    for held in (1, 50_000):
        assert {(tuple(r["votes"]), tuple(r["columns"])): r["n"] for r in pii.candidate_counts(docs, held=held).collect()} == counted


WORDS = st.lists(st.text("ab", max_size=4), min_size=1, max_size=30)


@settings(max_examples=100, deadline=None)
@given(WORDS, st.sampled_from([0.01, 0.5, 1.5]), st.text("ab", max_size=3), st.text("ab", max_size=3))
def test_compatibility_counted_from_the_strings(strings, alpha, p, q):
    """Two states of the prefix tree, compared by shares that are counted in the sample itself."""
    tree = Automaton(64)
    for s in strings:
        tree.add(s)

    def state(prefix):
        at = 0
        for c in prefix:
            if c not in tree.edges[at]:
                return None
            at = tree.edges[at][c][0]
        return at

    def under(prefix):
        return sum(s.startswith(prefix) for s in strings)

    def alike(x, y):
        n1, n2 = under(x), under(y)
        if not n1 or not n2:
            return True
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)
        shares = [(strings.count(x), strings.count(y)), *((under(x + c), under(y + c)) for c in "ab")]
        return all(abs(f1 / n1 - f2 / n2) <= bound for f1, f2 in shares) and all(alike(x + c, y + c) for c in "ab" if under(x + c) and under(y + c))

    if state(p) is not None and state(q) is not None and p != q:
        assert tree._compatible(state(p), state(q), alpha) == alike(p, q)


@settings(max_examples=100, deadline=None)
@given(WORDS, st.sampled_from([1e-6, 0.05, 1.0]))
def test_merging_keeps_all_counts(strings, alpha):
    machine = infer(strings, alpha)
    arrivals, endings, symbols = [0] * len(machine.arrivals), [0] * len(machine.arrivals), 0
    for s in strings:  # every string of the sample has its way through the automaton
        at = 0
        for c in s:
            arrivals[at] += 1
            symbols += 1
            at = machine.edges[at][c][0]
        arrivals[at] += 1
        endings[at] += 1
    assert (arrivals, endings) == (machine.arrivals, machine.endings)
    assert symbols == sum(n for e in machine.edges for _, n in e.values())
    assert len(machine.arrivals) <= len({s[:i] for s in strings for i in range(len(s) + 1)})


def planted(spark, docs, forms, decoys, seed):
    """Documents with one form or decoy put between two words of each, and which span each form has."""
    draw = random.Random(seed)
    rows, spans = [], {}
    for r in docs:
        text = r["text"] or ""
        at = text.find(" ", len(text) // 2)
        if at < 0:
            continue
        good = draw.random() < 0.5
        before, body = draw.choice(forms if good else decoys)(draw)
        at += 1
        rows.append((r["doc_id"], f"{text[:at]}{before} {body} {text[at:]}"))
        spans[r["doc_id"]] = (good, at + len(before) + 1, at + len(before) + 1 + len(body))
    return spark.createDataFrame(rows, "doc_id long, text string"), spans


def rates(found, spans):
    """Recall of the forms, and which share of the spans that touch a form or decoy touches a form."""
    hit = {True: 0, False: 0}
    for i, (good, a, b) in spans.items():
        hit[good] += any(int(x) < b and int(y) > a for x, y in (s.split(":")[1:] for s in found[i].split(",") if s))
    return hit[True] / sum(g for g, _, _ in spans.values()), hit[True] / max(1, sum(hit.values()))


def test_rates_of_added_personal_data(spark, documents):
    word = lambda d: "".join(d.choices("abcdefghijklmnop", k=6))
    number = lambda d, n: "".join(d.choices("0123456789", k=n))
    forms = [
        lambda d: ("mail", f"{word(d)} [at] {word(d)} [dot] com"),
        lambda d: ("contact", f"{word(d)}.{word(d)} (at) {word(d)}.org"),
        lambda d: ("phone", f"415-555-{number(d, 4)}"),
        lambda d: ("call", f"(212) 555-{number(d, 4)}"),
    ]
    decoys = [lambda d: ("order no", f"1234-5678-9012-{number(d, 4)}"), lambda d: ("version", f"{number(d, 1)}.{number(d, 2)}.{number(d, 3)}"), lambda d: ("page", f"{number(d, 3)}-{number(d, 3)}"), lambda d: ("invoice", number(d, 10))]
    docs, spans = planted(spark, documents.collect(), forms, decoys, 4)
    recall, precision = rates({r["doc_id"]: r["spans"] for r in pii.find(docs, pii.fit(docs)).collect()}, spans)
    print(f"personal data: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
    # forms and decoys planted in documents that the model has not seen
    rows = documents.collect()
    taught, _ = planted(spark, rows[: len(rows) // 2], forms, decoys, 5)
    docs, spans = planted(spark, rows[len(rows) // 2 :], forms, decoys, 6)
    recall, precision = rates({r["doc_id"]: r["spans"] for r in pii.find(docs, pii.fit(taught)).collect()}, spans)
    print(f"personal data, unseen: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_rates_of_added_secrets(spark, documents):
    token = lambda d: "zq_" + "".join(d.choices("abcdefghijkmnpqrstuvwxyz23456789", k=24))
    forms = [lambda d: ("it was", token(d)), lambda d: ("header", f"auth={token(d)}"), lambda d: ("with", f"{token(d)}.")]
    decoys = [lambda d: ("number", "".join(d.choices("0123456789", k=16))), lambda d: ("the word", "".join(d.choices(["ing", "tion", "the", "and", "er"], k=5))), lambda d: ("path", "usr/share/lib" + "".join(d.choices("abc/", k=5)))]
    rows = documents.collect()
    half = len(rows) // 2
    docs, spans = planted(spark, rows[:half], forms, decoys, 5)
    draw = random.Random(6)
    labelled = spark.createDataFrame([(10**6 + r["doc_id"], f"{r['text']} token = {token(draw)}") for r in rows[half:]], "doc_id long, text string")
    docs = docs.union(labelled)
    recall, precision = rates({r["doc_id"]: r["spans"] for r in secrets.find(docs, secrets.fit(docs)).collect()}, spans)
    print(f"secrets: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
