"""Test texts. Secret-shaped values are assembled at run time from parts and a seeded generator."""

import base64
import json
import random
import string

ALNUM = string.ascii_uppercase + string.ascii_lowercase + string.digits
BASE32 = string.ascii_uppercase + "234567"
LOWER = string.ascii_lowercase + string.digits
HEX = string.digits + "abcdef"
WIDE = ALNUM + "+/"
_random = random.Random(1931)


def rnd(chars: str, n: int) -> str:
    return "".join(_random.choice(chars) for _ in range(n))


def shaped(*parts) -> str:
    """A value from fixed strings and ``(characters, length)`` pairs."""
    return "".join(p if isinstance(p, str) else rnd(*p) for p in parts)


#: Formats that are found wherever they stand: placeholder label and parts of the value.
FORMATS = (
    ("SQUARE_ACCESS_TOKEN", "sq0", "atp-", (ALNUM, 22)),
    ("DOPPLER_API_TOKEN", "dp", ".pt.", (LOWER, 43)),
    ("LINEAR_API_KEY", "lin", "_api_", (LOWER, 40)),
    ("DATABRICKS_API_TOKEN", "da", "pi", (HEX, 32)),
    ("SHOPIFY_ACCESS_TOKEN", "shp", "at_", (HEX, 32)),
    ("DIGITALOCEAN_PAT", "do", "p_v1_", (HEX, 64)),
    ("TWILIO_API_KEY", "S", "K", (HEX, 32)),
    ("SENDGRID_API_TOKEN", "SG", ".", (ALNUM, 22), ".", (ALNUM, 43)),
    ("NPM_ACCESS_TOKEN", "np", "m_", (LOWER, 36)),
    ("GCP_API_KEY", "AI", "za", (ALNUM, 35)),
    ("STRIPE_KEY", "sk", "_live_", (ALNUM, 24)),
    ("GITLAB_PAT", "gl", "pat-", (ALNUM, 20)),
    ("GITHUB_TOKEN", "gh", "o_", (ALNUM, 36)),
    ("GITHUB_TOKEN", "gh", "p_", (ALNUM, 36)),
    ("AWS_ACCESS_KEY", "AK", "IA", (BASE32, 16)),
    ("VAULT_SERVICE_TOKEN", "s", ".", (LOWER, 24)),
    ("ANTHROPIC_API_KEY", "sk-", "ant-api03-", (ALNUM, 93), "AA"),
    ("OPENAI_API_KEY", "sk-", "proj-", (ALNUM, 74), "T3Blbk", "FJ", (ALNUM, 74)),
    ("SLACK_BOT_TOKEN", "xo", "xb-", (string.digits, 12), "-", (string.digits, 12), "-", (ALNUM, 24)),
)
SURROUNDINGS = ("rotate {} before Friday", "old value {} (revoked)", "see {} then retry", "{} was pasted here")


def key_block(lines: int) -> str:
    body = "\n".join(rnd(WIDE, 64) for _ in range(lines))
    return "-----BEGIN EC PRIV" + f"ATE KEY-----\n{body}\n-----END EC PRIV" + "ATE KEY-----"


def signed_token() -> str:
    parts = [json.dumps(x).encode() for x in ({"alg": "ES256", "kid": "k1"}, {"iss": "shop", "n": 7})]
    return ".".join(base64.urlsafe_b64encode(p).decode().rstrip("=") for p in parts) + "." + rnd(ALNUM, 52)


def positives():
    """(label, text, value that must go, start of the placeholder)."""
    out = []
    for i, (label, *parts) in enumerate(FORMATS):
        value = shaped(*parts)
        out.append((f"format {i}", SURROUNDINGS[i % len(SURROUNDINGS)].format(value), value, f"{label}_"))
    in_context = (
        ("a date for a card", "4000 0566 5566 5556", "CARD_", "paid with {} on Monday"),
        ("card in a field", "6011111111111117", "CARD_", "account|{}|ok"),
        ("account number", "FR14 2004 1010 0505 0001 3M02 606", "IBAN_", "transfer to {} done"),
        ("compact account number", "NL91ABNA0417164300", "IBAN_", "to={}"),
        ("phone with country", "+49 30 901820", "PHONE_", "ring {} after six"),
        ("phone with area", "(212) 555-0187", "PHONE_", "desk {} east"),
        ("mailbox", "lee+news@mail.example.org", "EMAIL_", "write to {}."),
        ("address of four", "203.0.113.77", "IP_", "lost route to {} again"),
        ("address of eight", "2001:0db8:0000:0042:0000:8a2e:0370:7334", "IP_", "peer {} left"),
        ("short address of eight", "fd00:abcd::17", "IP_", "peer {} joined"),
        ("header", rnd(ALNUM, 44), "BEARER_TOKEN_", "> Authorization: Bearer {}"),
        ("basic header", rnd(ALNUM, 28), "BASIC_AUTH_", "authorization: basic {}"),
        ("login of an address", rnd(ALNUM, 15), "PASSWORD_", "fetching https://robot:{}@packages.example.org/simple"),
        ("login of a database", rnd(ALNUM, 18), "DB_PASSWORD_", "store is postgres://ledger:{}@pg.example.org/main"),
        ("settings line", "Winter" + rnd(ALNUM, 8), "PASSWORD_", "SMTP_PASSWORD={}"),
        ("quoted settings line", rnd(ALNUM, 26), "SECRET_", 'set WEBHOOK_SECRET="{}"'),
        ("member of an object", rnd(ALNUM, 32), "SECRET_", '{{"realm": "shop", "client_secret": "{}"}}'),
        ("random looking member", rnd(ALNUM, 33) + "4", "SECRET_", "x_signature={} attempt=2"),
        ("signed token", signed_token(), "JWT_", "cookie {} expired"),
        ("key block", key_block(3), "PRIVATE_KEY_", "file follows\n{}\nend of file"),
        ("login of a call", "ops:" + rnd(ALNUM, 15), "CURL_AUTH_USER_", "curl --user {} https://status.example.org/health"),
        ("manifest", "password: " + rnd(ALNUM, 18) + "==", "KUBERNETES_SECRET_YAML_", "kind: Secret\ndata:\n  {}\n"),
        ("manifest from below", "password: " + rnd(ALNUM, 18) + "==", "KUBERNETES_SECRET_YAML_", "data:\n  {}\nkind: Secret\n"),
        ("package source", "Qx" + rnd(ALNUM, 13) + "!", "NUGET_CONFIG_PASSWORD_", '<add key="ClearTextPassword" value="{}" />'),
        ("closing character", shaped("sntrys_", "eyJpYXQiO", (ALNUM, 20), "LCJyZWdpb25fdXJs", (ALNUM, 20), "_", (ALNUM, 43)), "SENTRY_ORG_TOKEN_", "report with {}"),
    )
    return out + [(label, context.format(value), value, prefix) for label, value, prefix, context in in_context]


def negatives():
    """Texts without any finding."""
    picture = "data:image/gif;base64," + base64.b64encode(bytes(i * 7 % 256 for i in range(1500))).decode()
    digest = "8f14e45fceea167a5a36dedd4bea2543" + "ab12cd34"
    return {
        "digests": f'commit {digest}\nparent 0a1b2c3\n{{"sha": "{digest}"}}',
        "pictures": f'<img src="{picture}">\n.icon {{ background: url({picture}) }}',
        "language": "By noon the queue was empty. Please keep the password rules short, and tell the new colleagues about them!",
        "releases": "moved from v3.11.4 to 4.0.1-rc.2, schema version=12.0.3.1",
        "amounts": "17 of 1690000000000 rows, 2.71828 on average, invoice 100200300400, on 127.0.0.1:9200",
        "programs": "let token = nextToken();\npassword: ${ADMIN_PASSWORD}\nsecret_key = os.environ[\"SIGNING\"]",
        "places": "GET https://docs.example.org/guide?chapter=4&view=print 304, drawing@3x.png in /opt/site/assets/img/index.css:12:3",
    }


def sample_log():
    """A log with values of all eight categories."""
    return "\n".join([
        "07:00:01 worker 4 up, release 9.3.1",
        "07:00:02 env S3_KEY=" + shaped("AK", "IA", (BASE32, 16)),
        f"07:00:02 env QUEUE_URL=amqp://orders:{rnd(ALNUM, 14)}@mq.example.org:5671/live",
        f'07:00:03 env COOKIE_SECRET="{rnd(ALNUM, 34)}"',
        "07:01:10 order 881 by noor@example.org, card 4000 0566 5566 5556, account NL91 ABNA 0417 1643 00",
        "07:01:11 seen from 203.0.113.9, then 198.51.100.4",
        "07:02:30 noor@example.org asks for a call at +49 30 901820",
        key_block(5),
        "07:03:00 done after 119 s",
        "",
    ])
