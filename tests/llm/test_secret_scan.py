import hashlib
import random
import re
import time

from oosgauge.llm.secret_scan import scan, secret_scan, without_secrets

NAME = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
RULES = (
    re.compile(r"(" + NAME + r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
)


def brute(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in rule.finditer(text or ""):
            if len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20, 24)[k - 1]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", " = ", ":", "'", '"', "=", " ", "abcdef12", "x", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é😀", "\n", "ſecret", "to"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(1500)]
    rows = list(enumerate([*texts, None, "", "f" * 200_000, "token=" * 20_000, "a=" * 50_000]))
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
    for r in secret_scan(df).collect():
        want = brute(rows[r.doc_id][1])
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("literal")) == written


def literals(text):
    return [text[a:b] for a, k, b in scan(text, text.encode()) if k == 3]


def test_names_literals_and_constants():
    assert literals('DB_PASS = "Xk29fj!2kfPq"') == ["Xk29fj!2kfPq"]
    assert literals("KEY_A = 'hU7kd92jfKx02'\nOTHER = KEY_A\nclient_secret: OTHER\n") == ["hU7kd92jfKx02"]
    assert literals('{"userName": "aB3dE5gH7jK9", "clientSecretValue": 1, "authToken" : "short"}') == []
    assert literals("password: changeme\npassphrase = some plain words here") == []
    assert literals("a_key = b\nb = a_key\nmy_secret_key := a_key") == []  # names that only name each other


def test_long_literals_names_and_columns():
    rng = random.Random(3)
    made = lambda k, more="": "".join(rng.choices("ABCXYZabcxyz0189" + more, k=k))
    jwt, key, quoted = made(800, "_-"), made(1600, "+/"), made(900, "{}")
    assert literals(f"Authorization: {jwt}\n") == [jwt]
    assert literals(f'private_key = "{key}"') == [key]
    assert literals(f"bearer='{quoted}'; x = 1") == [quoted]
    assert literals(f"auth_key{' ' * 30}={' ' * 200}{jwt}") == [jwt]
    assert literals(f'{{"{"section." * 30}private_key" : "{key}"}}') == [key]
    assert literals("x" * 300 + f"_pwd = {jwt}") == [jwt]


CASES = [
    ('auth_key: "aB3\\"dE5fG7hJ9kL1m"', ['aB3\\"dE5fG7hJ9kL1m']),
    ('auth_key = """\n  aB3dE5fG7\n  hJ9kL1m\n"""', ["aB3dE5fG7\n  hJ9kL1m"]),
    ('credential = "aB3xx" + "dE5fG7h9"', ["aB3xx", "dE5fG7h9"]),
    ('auth_key = ("aB3dE5f"\n   "G7hJ9kL1m")', ["aB3dE5f", "G7hJ9kL1m"]),
    ('K="aB3dE5fG7hJ9kL1m"; auth_key = K; K = "zz"', ["aB3dE5fG7hJ9kL1m"]),
    ('K="zz"; auth_key = K; K = "aB3dE5fG7hJ9kL1m"', []),
    ('K = "aB3dE5fG7"\nK += "hJ9kL1m"\nauth_key = K', ["aB3dE5fG7", "hJ9kL1m"]),
    ('K = "aB3dE5fG7hJ9"\nK = f(1)\nauth_key = K', []),
    ('auth_key = K\nK = "aB3dE5fG7hJ9"', ["aB3dE5fG7hJ9"]),
    ('cfg.K = "aB3dE5fG7hJ9kL1m"\nauth_key = cfg.K', ["aB3dE5fG7hJ9kL1m"]),
    ('cfg = {"K": "aB3dE5fG7hJ9kL1m"}\nauth_key = cfg.K', ["aB3dE5fG7hJ9kL1m"]),
    ("K=aB3dE5fG7hJ9kL\nauth_key=${K}\n", ["aB3dE5fG7hJ9kL"]),
    ("<authKey>aB3dE5fG7hJ9kL1m</authKey>", ["aB3dE5fG7hJ9kL1m"]),
    ('<add key="AuthKey" value="aB3dE5fG7hJ9kL1m"/>', ["aB3dE5fG7hJ9kL1m"]),
    ('<entry name="authKey"> aB3dE5fG7hJ9kL1m </entry>', ["aB3dE5fG7hJ9kL1m"]),
    ("credentials:\n  user: bob\n  value: aB3dE5fG7hJ9kL1m\nvalue: qB3dE5fG7hJ9kL1m", ["aB3dE5fG7hJ9kL1m"]),
    ("[credentials]\nvalue = aB3dE5fG7hJ9kL1m\n", ["aB3dE5fG7hJ9kL1m"]),
    ("private_key: |\n  aB3dE5fG7hJ9kL1m\n  QQ3dE5fG7hJ9kL1m\nnext: 1", ["aB3dE5fG7hJ9kL1m\n  QQ3dE5fG7hJ9kL1m"]),
    ('auth_key = os.getenv("AUTH_KEY_9")', []),
    ('var authKey string = "aB3dE5fG7hJ9kL1m"', ["aB3dE5fG7hJ9kL1m"]),
    ('auth_key: str = "aB3dE5fG7hJ9kL1m"', ["aB3dE5fG7hJ9kL1m"]),
    ('config["auth_key"] = "aB3dE5fG7hJ9kL1m"', ["aB3dE5fG7hJ9kL1m"]),
    ('# auth_key = "aB3dE5fG7hJ9kL1m"', ["aB3dE5fG7hJ9kL1m"]),
    ('K = "aB3dE5fG7hJ9kL1m"\n# K = "zz"\nauth_key = K', ["aB3dE5fG7hJ9kL1m"]),  # a comment binds nothing
    ('if auth_key == "aB3dE5fG7hJ9": x', ["aB3dE5fG7hJ9"]),
    ('conn = "Server=a;Pwd=aB3dE5fG7hJ9;Db=x"', ["aB3dE5fG7hJ9"]),
    ("don't key: it's fine", []),
]


def test_syntax_of_sources_and_settings():
    for text, want in CASES:
        assert literals(text) == want, text


def test_programs_against_a_slow_reading():
    """Random straight-line programs: the reference runs them statement by statement and keeps whole lists of parts."""
    rng = random.Random(9)
    for _ in range(300):
        lines, env, want, made = [], {}, set(), 0
        for _ in range(rng.randrange(1, 12)):
            name = rng.choice(["A", "B", "cfg.C", "dev_auth_key", "my_credential"])
            terms, parts = [], []
            for _ in range(rng.randrange(1, 4)):
                known = [n for n in env if n != "dev_auth_key"]
                if known and rng.random() < 0.4:
                    n = rng.choice(known)
                    terms.append(n)
                    parts += env[n]
                else:
                    made += 1
                    literal = f"aZ{made}q" + "".join(rng.choices("bcdXYZ345", k=9))
                    quote = rng.choice("\"'")
                    terms.append(quote + literal + quote)
                    parts.append(literal)
            lines.append(f"{name}{rng.choice([' = ', '=', ' := '])}{rng.choice([' + ', '+', ' +  ']).join(terms)}{rng.choice(['', ' # note', ';'])}")
            env[name] = parts
            if name in ("dev_auth_key", "my_credential"):
                want |= set(parts)
        text = "\n".join(lines)
        assert set(literals(text)) == want, text


def test_long_rows_of_syntax_are_read_once():
    made = ["<a key='b' " * 60_000, "<a " + "key='b' " * 60_000, "string " * 100_000 + "= 1", "{" * 100_000 + "a:1," * 50_000]
    made += ["K=K+K\n" * 1_000 + "auth_key=K", 'K="a"\n' + 'K+="aB3"\n' * 30_000 + "auth_key=K", "a_key=b_key\n" * 50_000, "='''" * 60_000]
    made += ['\\"' * 150_000, "a: |\n  b\n" * 30_000, "-" * 200_000 + "a:b", "".join(f"k{i}_key = k{i + 1}_key\n" for i in range(30_000))]
    made += ["=(" * 100_000, "a='x' 'y'" * 40_000, "a: 'x: \"y: " * 30_000]
    for text in made:
        began = time.process_time()
        literals(text)
        assert time.process_time() - began < 5, text[:20]


def test_long_rows_are_read_once():
    for text in ("=" * 300_000, "a=" * 150_000, 'a="' * 100_000, "a='x" * 80_000, " :" * 150_000, "a" * 300_000 + ":", ("a" + " " * 50 + ":\n") * 6_000, '"a":' * 80_000, "pwd='" + "".join(map(chr, range(0x4E00, 0x9E00))) * 10 + "'"):
        began = time.process_time()
        literals(text)
        assert time.process_time() - began < 5


def test_redaction_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, 'x token = "abcdef1234" y', 24), (1, 'x token = "abcdef1234" y', 24), (None, None, None), (2, "clean", 5)], "doc_id long, text string, n_chars int")
    got = sorted((tuple(r) for r in without_secrets(docs, length_col="n_chars").collect()), key=str)
    assert got == sorted([(1, 'x [secret]" y', 13), (1, 'x [secret]" y', 13), (None, None, None), (2, "clean", 5)], key=str)
    assert secret_scan(docs.limit(0)).count() == 0
