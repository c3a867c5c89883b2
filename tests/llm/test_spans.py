import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from authornet.llm import pii, secrets_scan

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(list("ab@.%+-_ ()19") + ["a@b.c", "1.2.3.4", "+1 (2", "4111 1111", "1111 1111", "255.", "256."]), max_size=25))
def test_base_spans_of_personal_data(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_query(results, texts):
    for r in results("op4_pii"):
        base = plain_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(pii.digest(base).split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def all_labellings(lat):
    """Every way to cover the tokens with outside tokens and labelled segments."""
    def go(at):
        if at == lat.n:
            yield []
            return
        for rest in go(at + 1):
            yield [(at, at + 1, -1, 0), *rest]
        for k, (i, j) in enumerate(lat.segments):
            if i == at:
                for rest in go(j):
                    for kind in range(len(pii.KINDS)):
                        yield [(i, j, k, kind + 1), *rest]
    return go(0)


def test_semi_markov_sums_and_best_labelling():
    text = "x@y.zz 1.2.3.4"
    lat = pii.Lattice(text, 0, len(text))
    assert lat.segments
    rng = np.random.default_rng(1)
    w, outside, trans = (x + rng.normal(0, 0.5, x.shape) for x in pii.prior_weights())
    seg, out = lat.scores(w, outside, trans)
    scores, best = [], (-np.inf, None)
    for labelling in all_labellings(lat):
        s, last = 0.0, 0
        for i, _, k, label in labelling:
            s += trans[last, label] + (out[i] if k < 0 else seg[k, label - 1])
            last = label
        scores.append(s)
        if s > best[0]:
            best = (s, [(k, label - 1) for _, _, k, label in labelling if k >= 0])
    z, seg_p, _, _ = lat.expectations(w, outside, trans)
    assert z == pytest.approx(np.logaddexp.reduce(scores))
    assert lat.best(w, outside, trans) == best[1]
    assert (seg_p <= 1 + 1e-9).all()


def test_the_field_finds_what_the_patterns_drop():
    weights = pii.train(["Call +1 (017) 555-7713 now", "card 4111 1111 1111 1111 ok", "ab 10.0.0.1 cd", "mail jo@ex.org", "no 1234567 here"])
    text = "Des +1 (826) 555-4081 190.137.2.9 fin"  # the phone pattern runs into the address and fails
    base, every = pii.find_spans(text, weights)
    assert base == [("ip", 22, 33)] and ("phone", 4, 21) in every
    assert pii.find_spans("Only 12 words and 345 numbers.", weights) == ([], [])


def test_very_long_runs_take_linear_time():
    text = "1" * 200_000 + "a" * 200_000 + "@" + "password " * 2000 + "=" * 1000
    pii.base_spans(text), pii.zones(text), secrets_scan.find_spans(text)


SECRETS = {"assign": r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
           "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain_secrets(text):
    out = []
    for kind, pattern in SECRETS.items():
        for m in re.finditer(pattern, text, re.A):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(SECRETS).index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["token", "Api_Key", "SECRET", "password", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678",
                                 "0123456789abcdef", "g", "x9/+", "\n"]), max_size=20))
def test_base_spans_of_secrets(parts):
    text = "".join(parts)
    assert secrets_scan.base_spans(text) == plain_secrets(text)


def test_secrets_query(results, texts):
    for r in results("op7_secrets"):
        base = plain_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(secrets_scan.digest(base).encode()).hexdigest()
        assert set(secrets_scan.digest(base).split(",")) - {""} <= set(r["spans"].split(","))


@pytest.mark.parametrize("text, literals", [
    ('db_pwd = "hunter2!x9"', ["hunter2!x9"]),
    ('k = "Zx81jAq0Pq"\nother = 1\nclient_secret = k', ["Zx81jAq0Pq"]),
    ('"private_key": "MIIEvQIB" + "ADANBgkqh9"', ["MIIEvQIB", "ADANBgkqh9"]),
    ("token_count: 12345678", []), ("passphrase = ${PASS}", []), ("url: https://foo.bar/x9Zq?y=1", []), ("colour = 'a8Xk29Qm'", []),
])
def test_literals_that_sensitive_names_reach(text, literals):
    _, every = secrets_scan.find_spans(text)
    assert [text[s:e] for k, s, e in every if k == "literal"] == literals


def random_text(alphabet, size, seed=5):
    return "".join(np.random.default_rng(seed).choice(list(alphabet), size))


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/"


def literals_of(text):
    return [text[s:e] for k, s, e in secrets_scan.find_spans(text)[1] if k == "literal"]


def test_literals_of_any_length_are_reported_whole():
    key = random_text(BASE64, 4360)
    key = key[:2000] + "xXx" + key[2000:]  # letters that a placeholder has, by chance
    assert literals_of(f"client-key-data: {key}\nx: 1") == [key]
    assert literals_of(f'private_key = "{key}"') == [key]
    assert literals_of(f"k = '{key}'\nclient_credential = k") == [key]
    parts = [random_text(BASE64, 20, i) for i in range(200)]
    assert literals_of("private_key = " + " + ".join(f'"{p}"' for p in parts)) == parts


@pytest.mark.parametrize("value", ["changeme", "your-api-key-here", "example_password", "sk-xxxxxxxxxxxx", "<your token>", "${DB_PASS}",
                                   "{{ db_pass }}", "Bearer ${TOKEN}", "placeholder1", "********"])
def test_placeholders_are_whole_literals(value):
    assert literals_of(f'db_pwd = "{value}"') == []


def test_nested_chains_take_linear_time():
    doubled = 'a0 = "Zx81jAq0Pq"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(20_000)) + "db_pwd = a20000"
    assert literals_of(doubled) == ["Zx81jAq0Pq"]
    assert len(literals_of("db_pwd = " + " + ".join(['"x9Zq"'] * 50_000))) == 50_000
    assert literals_of('db_pwd = "' + 'a="' * 100_001) is not None


SECRET = "Zx81jAq0PqW9"


@pytest.mark.parametrize("text, literals", [
    (f'cfg["db_pwd"] = "{SECRET}"', [SECRET]), (f"cfg['db_pwd']='{SECRET}'", [SECRET]), (f'db_pwd: str = "{SECRET}"', [SECRET]),
    (f'db_pwd: dict[str, int] | None = "{SECRET}"', [SECRET]), (f'db_pwd = f"{SECRET}"', [SECRET]), (f"db_pwd = Rb'{SECRET}'", [SECRET]),
    (f'db_pwd = """{SECRET}"""', [SECRET]), (f"db_pwd = `{SECRET}`", [SECRET]),
    (f"private_key: |\n  MIIEvQIBADANBgkqh9\n\n  {SECRET}\nnext: 1", [f"MIIEvQIBADANBgkqh9\n\n  {SECRET}"]),
    (f"a:\n  private_key: >-\n    {SECRET}\n  b: 2", [SECRET]), ("private_key: |\nnext: 1", []),
    (f"<db_pwd>{SECRET}</db_pwd>", [SECRET]), (f'<add name="x" db_pwd="{SECRET}"/>', [SECRET]), (f"<p>{SECRET}</p>", []),
    (f'define("DB_PWD", "{SECRET}")', [SECRET]), (f"env.setdefault('DB_PWD', '{SECRET}')", [SECRET]), (f'look("DB_PWD", "{SECRET}")', []),
    (f'client_pwd = K1\nK1 = "{SECRET}"', [SECRET]), (f'client_pwd = K1 + "x81Qa9"\nK1 = "{SECRET}"', ["x81Qa9", SECRET]),
    (f"ENV DB_PWD {SECRET}", [SECRET]), (f"export DB_PWD={SECRET}", [SECRET]), (f"set DB_PWD {SECRET}", [SECRET]),
    (f'db_pwd = (\n  "{SECRET}"\n  "PqW9abcd")', [SECRET, "PqW9abcd"]), (f'$db_pwd = "{SECRET}" . "jAq0PqW9";', [SECRET, "jAq0PqW9"]),
    (f'db_pwd => "{SECRET}", db_pwd := "{SECRET}"', [SECRET] * 2), (f"it's db_pwd = '{SECRET}' isn't it", [SECRET]),
    (f"he wrote: \"then db_pwd = '{SECRET}'\" and left", [SECRET]), (f'x = y == "{SECRET}"', []),
    ('db_pwd = "correct horse battery staple zebra"', ["correct horse battery staple zebra"]),
    ('passphrase = "one two three four five six"', ["one two three four five six"]), ('note = "one two three four five six"', []),
    ('pwd_text = "Please enter your password to continue."', []),
    ("primary_key: user_identifier_42", []), ("private: MyClassName123", []), ("signing_key = settings.SIGNING_KEY", []),
    ("n" * 130 + f' = "{SECRET}"\ndb_pwd = ' + "n" * 130, [SECRET]), ("k" * 500 + f'_pwd = "{SECRET}"', [SECRET]),
])
def test_syntax_of_assignments(text, literals):
    assert literals_of(text) == literals


def test_planted_secrets_are_found_and_other_literals_left():
    """Precision and recall of the added spans on planted lines in prose."""
    rng = np.random.default_rng(11)
    forms = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', 'cfg["{n}"] = "{v}"', "{n}: str = '{v}'", "<{n}>{v}</{n}>", 'define("{n}", "{v}")', "ENV {n} {v}"]
    bad_names, good_names = ["db_pwd", "client_credential", "signing_private_key", "authPassphrase"], ["colour", "file_name", "session_count", "title", "public_key"]
    hits = wrong = planted = 0
    for i in range(400):
        value = random_text(BASE64[:62], int(rng.integers(10, 40)), 1000 + i) + "7q"
        sensitive = i % 2 == 0
        names = bad_names if sensitive else good_names
        line = forms[i % len(forms)].format(n=names[i % len(names)], v=value)
        found = literals_of(f"It was, as he's said, a day.\n{line}\nThe end: nothing more.")
        planted += sensitive
        hits += sensitive and found == [value]
        wrong += not sensitive and bool(found)
    assert hits == planted == 200 and wrong == 0


def test_lexing_takes_linear_time():
    import time
    for unit in ('"\\"', "'", '= "', "<a", "x[", 'k: |\n ', "a = (\n", '"""', "define(", "`", "k: list[", "_" * 50 + "="):
        took = []
        for n in (4_000, 32_000):
            t0 = time.perf_counter()
            secrets_scan.find_spans(unit * n)
            took.append(time.perf_counter() - t0)
        assert took[1] < 20 * took[0] + 0.5, unit


def sure_weights():
    w, outside, trans = pii.prior_weights()
    return 3 * w, outside, trans


def minified(rows, at, number):
    """JSON without white space; a telephone number that no pattern finds in the given row."""
    row = lambda k: f'{{"n":"a","tel":"{number}"}}' if k == at else '{"n":"abcdefghij"}'
    return "x [" + ",".join(row(k) for k in range(rows)) + ",{9}] 1"


def test_zones_follow_the_whole_run():
    text = minified(3000, 1500, "(030) 555-40817-22")
    assert all(s == 0 or text[s - 1].isspace() for s, _ in pii.zones(text))
    assert all(e == len(text) or text[e].isspace() for _, e in pii.zones(text))


@pytest.mark.parametrize("shift", range(0, 40, 3))
def test_entities_on_any_border_are_whole(shift):
    weights = sure_weights()
    number = "(030)555-408-172"
    near = pii.find_spans(f"tel {number}", weights)[1]
    assert near == [("phone", 4, 4 + len(number))]
    for gap in (400, 11_000):  # the old pieces' border, and the border of a window
        lead = "1" + "a" * shift + "," + "ab," * (gap // 3)
        text = f"tel {lead}{number},ab"
        found = pii.find_spans(text, weights)[1]
        assert found == [("phone", 4 + len(lead), 4 + len(lead) + len(number))]


def test_windows_decode_as_one_lattice():
    rng = np.random.default_rng(3)
    parts = ["(030)555-408-172", "12.7", "ab", "x9", "10.0.0.1", "1234567"]
    zone = ",".join(rng.choice(parts, 1200))
    text = "tel " + zone + " end"
    assert len(list(pii.windows(text, 4, 4 + len(zone)))) > 3
    weights = sure_weights()
    lat = pii.Lattice(text, 4, 4 + len(zone))
    seg_p = lat.expectations(*weights)[1]
    base = pii.base_spans(text)
    whole = [(pii.KINDS[kind], *lat.spans[k]) for k, kind in lat.best(*weights) if seg_p[k, kind] >= pii.MIN_PROBABILITY
             and not any(s < lat.spans[k][1] and lat.spans[k][0] < e for _, s, e in base)]
    assert whole and pii.added_spans(text, base, weights) == whole


def test_training_windows_keep_features():
    text = "tel " + ",".join(["(030)555-408-172", "a" * 5000, "10.0.0.1"] * 300)
    rows = list(pii.training_windows(text))
    assert len(rows) > 2 and all(len(r[0]) < 200 * 1200 for r in rows)
    first, end = pii.zones(text)[0]
    for (sample, cue, s, e, marked), (_, _, ws, we) in zip(rows, pii.windows(text, first, end)):
        one, other = pii.Lattice(sample, s, e, cue), pii.Lattice(text, ws, we, first)
        assert marked and one.segments == other.segments and (one.rows == other.rows).all()
