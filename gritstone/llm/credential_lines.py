"""Lines of code to fit the credential field on: made from templates, and real code without secrets."""

from __future__ import annotations

import importlib.util
import random
from collections.abc import Iterator
from pathlib import Path

_NOUNS = "river stone cloud field meadow garden copper silver amber forest pilot rocket candle window harvest letter basket turtle wagon planet market bridge castle engine".split()
_VERBS = "load read write send open close merge split count build parse render update remove check find start stop".split()
_AN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX = "0123456789abcdef"
_NAMES = (
    "password passwd db_pass admin_pwd dbPassword secret clientSecret client_secret hookSecret API_KEY apiKey api_key token authToken auth_token access_token accessToken"
    " service_token signingKey signing_key private_key tls_key TOKEN CLIENT_SECRET SIGNING_KEY passphrase credentials bearerToken refresh_token encryptionKey mailPassword smtp_password"
).split()
_OTHER_NAMES = (
    "integrity etag contentHash treeId commit revision checksum image_digest requestId request_id traceUuid tenantId tenant_id buildSha build_sha publicKey sha256 commitSha file_hash"
    " fingerprint blobId object_id parentSha schemaVersion sessionUuid"
).split()
# Modules of the standard library whose lines are code without secrets.
_PLAIN_MODULES = "argparse ast asyncio.base_events calendar cmd codecs configparser csv dataclasses difflib getpass gettext hashlib hmac html.parser http.client http.cookies inspect json.decoder locale logging mimetypes netrc optparse pathlib pickle pprint secrets shlex shutil smtplib ssl string tarfile textwrap tokenize typing unittest.case urllib.parse uuid zipfile".split()


class Templates:
    """Random lines; secrets stand between the marks « and »."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *of):
        return self.r.choice(of)

    def chars(self, n: int, of: str = _AN) -> str:
        return "".join(self.r.choices(of, k=n))

    def noun(self) -> str:
        return self.r.choice(_NOUNS)

    def verb(self) -> str:
        return self.r.choice(_VERBS)

    def uuid(self) -> str:
        return "-".join(self.chars(n, _HEX) for n in (8, 4, 4, 4, 12))

    def phrase(self, n: int = 4) -> str:
        return " ".join(self.r.choices([*_NOUNS, *_VERBS, "the", "a", "of", "is", "not", "to", "and"], k=self.r.randint(2, n + 1)))

    def password(self) -> str:
        a, b, c, r = self.noun(), self.noun(), self.noun(), self.r
        leet = str.maketrans("aeio", "4310")
        return r.choice(
            [
                f"{a.title()}{r.choice('-!_.#+&@$')}{b}{r.randint(1, 999)}",
                f"{a.title()}{b.title()}{r.randint(1, 99)}{r.choice('!?*#.')}",
                f"{a}-{b}-{c}{r.randint(1, 99)}",
                (a + b).translate(leet) + str(r.randint(1, 99)),
                self.chars(r.randint(9, 16)) + r.choice("!+.?%*&"),
                self.chars(r.randint(10, 15)),
                f"{a}{b}{r.randint(1, 9999)}",
                f"{a}{r.randint(1, 9999)}",
            ]
        )

    def token(self) -> str:
        r = self.r
        return r.choice(
            [
                lambda: r.choice(["ghp_", "glpat-", "sk_live_", "npm_", "hf_", "rk_live_", "dop_v1_"]) + self.chars(r.randint(20, 38)),
                lambda: "AKIA" + self.chars(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                lambda: f"xoxb-{self.chars(12, '0123456789')}-{self.chars(24)}",
                lambda: f"{self.chars(3, 'abcdefghij')}_{r.choice(['prod', 'live', 'test'])}_{self.chars(28)}",
                lambda: f"{self.chars(3, 'abcdefghij')}_{self.chars(2, 'klmnopqrs')}_{self.chars(28)}",
                lambda: self.chars(r.randint(24, 40)),
                lambda: self.chars(43, _AN + "+/") + "=",
                lambda: self.chars(22, _AN + "+/"),
                lambda: self.chars(r.choice([32, 40, 40, 64]), _HEX),
                *[lambda: self.uuid()] * 3,
                lambda: "eyJ" + self.chars(30) + ".eyJ" + self.chars(50) + "." + self.chars(43, _AN + "-_"),
            ]
        )()

    def tail(self, base: str) -> str:
        return base + self.one("", "", f"_{self.chars(3, 'abcxyz')}", f"_{self.noun()}_{self.noun()}", self.noun().title() + self.noun().title(), f"_v{self.r.randint(0, 9)}")

    def secret_name(self) -> str:
        return self.tail(self.r.choice(_NAMES))

    def other_name(self) -> str:
        return self.tail(self.r.choice(_OTHER_NAMES))

    def plain_name(self) -> str:
        return self.tail(self.r.choice([*_NOUNS, "conf", "cfg", "options", "value", "docs", "host", "user", "path", "mode"]))

    def variable(self) -> str:
        return self.one(self.noun(), self.verb() + self.noun().title(), f"{self.noun()}_{self.noun()}", f"{self.noun()}{self.r.randint(0, 99)}", self.noun().title() + self.noun().title())

    def url(self, middle: str) -> str:
        host = self.one(f"{self.noun()}-{self.noun()}.net", f"db.{self.noun()}.io", f"10.0.{self.r.randint(0, 255)}.{self.r.randint(0, 255)}", self.noun(), f"{self.noun()}.cluster.local")
        return f"{self.one('postgres', 'mysql', 'https', 'redis', 'amqp', 'mongodb', 'ftp', 'smtp')}://{middle}{host}{self.one('', ':5432', ':443')}{self.one('', f'/{self.noun()}', f'/{self.noun()}?mode={self.noun()}')}"

    def assign(self, name: str, value: str) -> str:
        q = self.one("'", '"')
        return self.r.choice(
            [
                f"const {name} = {q}{value}{q};",
                f"let {name}: string = {q}{value}{q};",
                f"${name} = {q}{value}{q};",
                f"{name} = {q}{value}{q}",
                f'  "{name}": "{value}",',
                f"{name}: {value}",
                f'  {name}: "{value}",',
                f"{name}={value}",
                f"export {name.upper()}={q}{value}{q}",
                f"// {name} = {q}{value}{q}",
                f"#{name.upper()}={value}",
                *(f"{self.setting(sep)}\n{self.one('', '  ')}{self.one(name, name.upper())}{sep}{value}\n{self.setting(sep)}" for sep in ("=", " = ", ": ", "=")),
                f"  '{name}' => '{value}',",
                f"const options = {{ user: {q}{self.noun()}{q}, {name}: {q}{value}{q} }};",
                f"{self.plain_name()}({q}{name}{q}, {q}{value}{q});",
                f"{self.noun()}.set{name.title()}({q}{value}{q});",
                f"const {name} =\n  {q}{value}{q};",
                f"self.{name} = {q}{value}{q}  # {self.phrase()}",
            ]
        )

    def setting(self, sep: str) -> str:
        """A line of a configuration file that names nothing secret."""
        r = self.r
        value = r.choice([self.noun(), str(r.randint(0, 9999)), f"/{self.noun()}/{self.noun()}", f"{self.noun()}-{self.noun()}", f'"{self.noun()}"', "true", f"{self.noun()}.{self.noun()}.net", f"{self.noun()}{r.randint(1, 9)}"])
        return r.choice([f"{self.plain_name()}{sep}{value}", f"  {self.plain_name()}{sep}{value}", f"{self.plain_name().upper()}{sep}{value}", f"# {self.phrase()}", f"[{self.noun()}]", f"{self.noun()}:", ""])

    def pem(self, kind: str, mark: bool) -> str:
        a, b = ("«", "»") if mark else ("", "")
        gap, start, end = self.r.choice([("\\n", "const key = `", "`;"), ("\\n", 'key = "', '";'), ("\\n", "  key: '", "',"), ("\n", "", ""), ("\n", "tls = ", ""), ("\n", "const key = `", "`"), ("\\n'\n  . '", "$key = '", "';"), ('\\n" +\n  "', 'key = "', '"'), ("\n  ", "key: |\n  ", "")])
        rows = [64] * self.r.randint(1, 4) + self.one([], [self.r.randint(3, 60)])
        body = gap.join(f"{a}{self.chars(n, _AN + '+/')}{b}{self.one('', '=', '==')}" for n in rows)
        return f"{start}-----BEGIN {kind}-----{gap}{body}{gap}-----END {kind}-----{end}"

    def call(self) -> str:
        """Credentials handed to a function without a name of their own."""
        q = self.one("'", '"')
        secret = f"{q}«{self.password()}»{q}"
        return self.r.choice(
            [
                f"{self.one('connect', 'login', 'signIn', 'authenticate', 'db.connect', 'ftp.login', 'client.auth', 'server.login', 'session.authenticate')}({q}{self.noun()}{q}, {secret}){self.one(';', '', ' or die();')}",
                f"{self.noun()}.{self.one('login', 'authenticate', 'connect')}({self.noun()}, {secret})",
                f"mysqli_connect({q}{self.noun()}{q}, {q}{self.noun()}{q}, {secret}, {q}{self.noun()}{q});",
                f"{self.noun()}.{self.verb()}({q}{self.noun()}{q}, {secret}); {self.one('//', '#')} {self.one('password', 'pwd', 'the password', 'secret')}",
                f"auth=({q}{self.noun()}{q}, {secret})",
            ]
        )

    def positive(self) -> str:
        r = self.r
        t, p = f"«{self.token()}»", f"«{self.password()}»"
        note = self.one("//", "#")
        return r.choice(
            [
                lambda: self.assign(self.secret_name(), t),
                lambda: self.assign(self.secret_name(), t),
                lambda: self.assign(self.secret_name(), p),
                lambda: self.assign(self.secret_name(), p),
                lambda: self.assign(self.secret_name(), p),
                lambda: self.call(),
                lambda: self.call(),
                lambda: self.assign(self.plain_name(), self.url(f"{self.noun()}:{p}@")),
                lambda: self.assign(self.one("database_url", "dsn", "DATABASE_URL", "broker"), self.url(f"{self.noun()}:{p}@")),
                lambda: self.assign(self.plain_name(), self.url(f"{self.noun()}:«{self.chars(4)}{self.chars(4, '!(),;:+=[]&')}{self.chars(5)}»@")),
                lambda: f"const {self.plain_name()} = process.env.{self.noun().upper()}_{self.one('PASSWORD', 'TOKEN', 'KEY')} {self.one('||', '??')} '{r.choice([t, p])}';",
                lambda: f"${self.plain_name()} = getenv('{self.noun().upper()}_{self.one('TOKEN', 'SECRET', 'PWD')}') ?: '{r.choice([t, p])}';",
                lambda: f"{self.plain_name()} = os.environ.get('{self.noun().upper()}_{self.one('TOKEN', 'SECRET', 'PWD')}', '{r.choice([t, p])}')",
                lambda: f"const {self.plain_name()} = {{ Authorization: 'Bearer {t}' }};",
                lambda: f"const {self.plain_name()} = {{ Authorization: 'Basic «{self.chars(r.randint(18, 34))}{self.one('', '=', '==')}»' }};",
                lambda: f"  {self.one('Authorization', 'authorization')}: '{r.choice([t, p])}',",
                lambda: f"{note} {self.one('old key', 'rotate me:', 'works on staging:', 'TODO drop token', 'TODO remove api-key', 'temporary password is', 'old password:')} {t}",
                lambda: f"{note} {self.one('temporary password is', 'old password:', 'password:', 'pwd', 'pass:')} {p}",
                lambda: f"const {self.secret_name()} = '«{self.chars(16)}»' + '«{self.chars(16)}»';",
                lambda: f"{self.secret_name()} = '«{self.chars(16, _AN + '+/')}»' . '«{self.chars(r.randint(6, 16))}»';",
                lambda: f"const {self.secret_name()} = ['«{self.chars(12)}»', '«{self.chars(12)}»'].join('');",
                lambda: f"const {self.secret_name()} = [\n  '«{self.chars(12)}»',\n  '«{self.chars(12)}»',\n].join('');",
                lambda: f"{self.one('define', 'set', 'os.putenv')}('{self.secret_name().upper()}',\n  '{r.choice([t, p])}');",
                lambda: f"{self.noun()}:\n  {self.secret_name()}: >-\n    {r.choice([t, p])}",
                lambda: f"{self.one('exec', 'run', 'sh')}(`curl -H '{self.one('x-token', 'Authorization', 'x-api-key')}: {t}' {self.url('')}`)",
                lambda: f'{self.one("console.log", "print", "logger.info")}("{self.one("token", "secret", "x-api-key", "api-key", "auth")}", "{t}");',
                lambda: f'{self.one("md5", "sha1", "hmac")}("{self.one("secret", "token", "api-key")}" + "{t}"){self.one("", ";", " is weak")}',
                lambda: f"if ({self.secret_name()} === '{r.choice([t, p])}') {{",
                *[lambda: self.pem(self.one("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"), True)] * 2,
                lambda: f"{self.noun()}:\n  {self.secret_name()}: {self.one('>-', '|', '>')}\n    {p}\n  {self.setting(': ').strip()}",
            ]
        )()

    def stand_in(self) -> str:
        return self.one("TODO", "REPLACE_ME", "changeme", "your-api-key-here", "example-token", "********", "xxxxxxxxxxxx", "<TOKEN>", "${SECRET}", "", "<your-key>", "password", "CHANGE_ME", "dummy", "{{ token }}", "...", "%s", "not-set")

    def code(self) -> str:
        """A line of everyday code that names nothing secret."""
        r, v = self.r, self.variable
        q = self.one("'", '"')
        return r.choice(
            [
                lambda: f"import {{ {v()}, {v()} }} from {q}{self.one('./', '../', '@', '')}{self.noun()}/{self.noun()}{self.one('', '-' + self.noun(), '.js')}{q};",
                lambda: f"import {self.one('* as ', '')}{v()} from {q}{self.one('./', '../', '../../')}{self.noun()}/{v()}{self.one('-', '')}{r.randint(1, 9)}{self.chars(2, 'abcdef')}{self.one('', '.js')}{q};",
                lambda: f"//# sourceMappingURL={v()}{self.one('-', '')}{r.randint(1, 9)}{self.chars(2, 'abcdef')}{self.one('', '.min')}.js.map",
                lambda: f"const {{ {v()}, {v()} }} = require({q}{self.one('../', './')}{self.noun()}/{v()}{q});",
                lambda: f"from {self.noun()}.{self.noun()} import {v()}, {v()}",
                lambda: f"use {self.noun().title()}\\{self.noun().title()}\\{self.noun().title()}{self.one('', ' as ' + self.noun().title())};",
                lambda: f"export {self.one('async function', 'function', 'default function')} {v()}({v()}: {self.one('string', 'number', 'Map<string, ' + self.noun().title() + '>')}, {v()} = {r.randint(0, 99)}) {{",
                lambda: f"  public {self.one('static ', '')}function {v()}({self.one('array', 'string', '?int')} ${v()}, ${v()} = {q}{self.noun()}{r.randint(1, 99)}{q}): {self.one('void', 'array', 'bool')}",
                lambda: f"def {v()}({v()}, {v()}={q}{self.noun()}{q}, *, {v()}=None):",
                lambda: f"<?php {self.one('', 'declare(strict_types=1);', 'namespace ' + self.noun().title() + ';')}",
                lambda: f"<{self.one('div', 'span', 'p', 'li', 'button')} class={q}{self.noun()}-{self.noun()} {self.noun()}{r.randint(1, 12)}{q}>{{{v()}.{v()}}}</{self.one('div', 'span', 'p')}>",
                lambda: f"  return {v()}.{self.one('map', 'filter', 'find')}(({v()}) => {v()}.{v()} {self.one('===', '>', '!==')} {r.choice([q + self.noun() + q, str(r.randint(0, 999))])});",
                lambda: f"if (/^[{{(\\[{q}{self.chars(3, 'abcxyz')}]+{self.one(r'\d+', r'\w*', r'\s?')}$/{self.one('', 'i', 'gu')}.test({v()})) {{",
                lambda: f"const {v()} = {v()}.replace(/{self.noun()}[-_]?(\\d{{{r.randint(1, 4)}}})/g, {q}{self.noun()}-$1{q});",
                lambda: f"throw new Error(`{self.phrase()} ${{{v()}}} {self.noun()}: ${{{v()}.{v()}}}`);",
                lambda: f"raise ValueError(f{q}{self.phrase()} {{{v()}}} {self.noun()}{q})",
                lambda: f"{self.one('console.log', 'logger.debug', 'print', 'error_log')}({q}{self.phrase()}{q}, {v()});",
                lambda: f"it({q}{self.phrase(7)}{q}, async () => {{",
                lambda: f"expect({v()}({q}{self.noun()}{self.one('-', '_', '.', '')}{r.randint(1, 999)}{q})).toBe({r.choice([q + v() + q, str(r.randint(1, 99))])});",
                lambda: f"assert {v()}({q}{self.noun()}{r.randint(1, 99)}.{self.noun()}{q}) == {q}{self.noun()}-{r.randint(1, 99)}.{self.one('txt', 'json', 'log')}{q}",
                lambda: f"{v()}.{v()}({q}{v()}{q}, {q}{self.noun()}-{self.noun()}{self.one('', str(r.randint(1, 99)))}{q});",
                lambda: f"{v()}({q}{self.noun()}{q}, {q}{self.noun()}{r.randint(1, 99)}{q}, {r.randint(1, 999)})",
                lambda: f"{v()}.{v()} = function ({self.noun()}) {{ return {self.noun()}.{v()}({r.randint(1, 99)}, {q}{self.noun()}{r.randint(1, 999)}{q}); }};",
                lambda: f"{v()}.{v()}({v()}, {q}{self.noun()}{r.randint(1, 9999)}{q}, {self.one('{', '[]', 'null', v())});",
                lambda: f"{self.one('font', 'color', 'border')}: {self.one('#' + self.chars(6, _HEX), '1px solid #' + self.chars(3, _HEX), 'rgba(0, 0, 0, .5)')};",
                lambda: f"  {q}{self.noun()}{self.one('-', '_', '')}{self.noun()}{q}: {r.choice([q + self.noun() + str(r.randint(1, 99)) + q, q + self.noun() + '/' + self.noun() + q, 'true', 'null', str(r.random())])},",
                lambda: f"  [{', '.join(q + self.noun()[:3] + str(r.randint(0, 999)) + q for _ in range(r.randint(2, 6)))}],",
                lambda: f"{self.one('//', '#', ' *', '/**')} {self.phrase(9)} {self.one('', v() + '()', self.noun() + '.' + self.noun(), 'v' + str(r.randint(1, 9)) + '.' + str(r.randint(0, 20)))}.",
                lambda: f"{self.one('//', '#')} see https://{self.noun()}.org/{self.noun()}/{self.noun()}-{r.randint(1, 999)}#{self.noun()}",
                lambda: f"type {v()} = {{ {v()}: {self.one('string', 'number')}; {v()}?: {self.one('A', 'B')}[{q}{self.noun()}{q}] }};",
                lambda: f"${v()}[{q}{self.noun()}{q}] = $this->{v()}(${v()}, {q}{self.noun()}_{self.noun()}{q});",
                lambda: f"  {q}{self.one(self.noun().upper() + '_' + self.noun().upper() + self.one('', str(r.randint(1, 99))), v())}{q}: {r.choice([str(r.randint(0, 9)), q + q, v()])},",
                lambda: f"  ({q}{v()}{q}, {q}{self.noun()}{r.randint(1, 9)}{self.noun()}{q}): ({q}{v()}.{v()}{q}, {q}{self.noun()}{r.randint(1, 9)}{self.noun()}{q}),",
                lambda: f"{v()} = {v()}({r.random() * 1000:.6e}, {r.randint(1000, 10**12):_}, -{r.random():.9f}, {q}{self.noun().title()}{self.noun().title()}.{self.one('exe', 'dll', 'v2')}{q})",
                lambda: f"{self.one('', ' * ', '// ')}{self.phrase()} :attr:`{v()}.{v()}{r.randint(1, 9)}_{self.noun()}` and ``{v()}{r.randint(1, 9)}``",
                lambda: f"    {self.noun()}{r.randint(1, 99)}[{q}{self.noun()}{q}] = {{{q}{self.noun()}{q}: {r.randint(0, 9999)}}}",
                lambda: f"`{v()}` is {self.one('exported', 'imported', 'built')} {self.one('from', 'in')} {self.noun()}-{self.noun()}/{self.noun()}/{v()}{r.randint(1, 9)}{self.chars(2, 'abcdef')}{self.one('.ts', '.mjs', '.py')} but {self.phrase()}",
                lambda: f"SELECT {self.noun()}_id, {self.noun()} FROM {self.noun()}s WHERE {self.noun()} = {q}{self.noun()}{r.randint(1, 99)}{q};",
                lambda: f"!function({self.chars(1, 'etn')},{self.chars(1, 'rio')}){{var {self.chars(1, 'a')}{r.randint(1, 99)}={self.chars(1, 'etn')}.{v()}||{{}};return {self.chars(1, 'a')}{r.randint(1, 99)}.{v()}({q}{self.noun()}{r.randint(1, 99)}{q})}}",
                lambda: f"  {q}{self.phrase(6)} {r.randint(1, 99)}{q},",
                lambda: f"{v()} = {q}{self.chars(r.randint(200, 900), _AN + '+/')}{self.one('', '=', '==')}{q};",
                lambda: f"  {', '.join(hex(r.randint(0, 2**32)) for _ in range(r.randint(2, 8)))},",
                lambda: f"{r.randint(1000, 9999)},{self.noun()},{self.noun()}-{r.randint(1, 99)},{r.random():.4f}",
                lambda: f"version = {q}{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}{self.one('', '-beta.1', 'rc2')}{q}",
                lambda: f"host = {q}{self.noun()}-{r.randint(1, 40)}.{self.noun()}.net{q}",
                lambda: f"{self.one('port', 'user', 'mode', 'region', 'bucket')}: {r.choice([str(r.randint(80, 9999)), self.noun(), 'eu-west-' + str(r.randint(1, 3)), self.noun() + '-' + str(r.randint(1, 99))])}",
            ]
        )()

    def negative(self) -> str:
        r = self.r
        ident = r.choice([self.chars(40, _HEX), self.chars(64, _HEX), self.uuid(), self.uuid(), "sha512-" + self.chars(80, _AN + "+/") + "=="])
        stand = self.stand_in()
        return r.choice(
            [
                lambda: self.assign(self.secret_name(), stand),
                lambda: self.assign(self.secret_name(), stand),
                lambda: self.assign(self.other_name(), ident),
                lambda: self.assign(self.other_name(), ident),
                lambda: self.assign(self.plain_name(), self.url("")),
                lambda: self.assign(self.plain_name(), self.url(f"{self.noun()}@")),
                lambda: self.assign(self.plain_name(), self.url(self.one("USER:PASSWORD@", "<user>:<password>@", "${USER}:${PASSWORD}@", "user:password@", "user:****@", "{user}:{password}@", "%s:%s@"))),
                lambda: f"const {self.secret_name()} = process.env.{self.noun().upper()}_TOKEN;",
                lambda: f"{self.secret_name()} = os.environ['{self.noun().upper()}_TOKEN']",
                lambda: f"${self.secret_name()} = getenv('{self.noun().upper()}_TOKEN');",
                lambda: f"const {self.secret_name()} = {self.one('await ', '')}{self.verb()}{self.one('Secret', 'Token', 'Password')}({self.variable()}{self.one('', f', {self.noun()}')});",
                lambda: f"const {self.secret_name()} = {self.noun()}.{self.secret_name()};",
                lambda: f"{self.one('if', 'while')} ({self.secret_name()} {self.one('===', '!==', '>')} {self.variable()}.{self.variable()}) {{",
                lambda: f"function {self.verb()}{self.one('Password', 'Token', 'Key')}({self.secret_name()}: string, {self.variable()}: {self.noun().title()}{r.randint(1, 9)}) {{",
                lambda: f"def {self.verb()}_{self.one('password', 'token', 'key')}(self, {self.secret_name()}, {self.variable()}={r.randint(1, 9)}):",
                lambda: f"import {{ {self.one('tokenize', 'token', 'password', 'authKey')}{self.noun().title()}, {self.variable()} }} from '{self.one('./', '../')}{self.noun()}/{self.noun()}-{self.chars(3, _HEX)}';",
                lambda: f"<input type=\"password\" name=\"{self.noun()}{r.randint(1, 9)}\" placeholder=\"{self.phrase()}\">",
                lambda: self.assign(self.tail("password_file"), f"/run/{self.noun()}/{self.noun()}{r.randint(1, 9)}"),
                lambda: self.assign(self.tail(self.one("token_ttl", "secret_name", "auth_token_header", "password_file", "tokenType", "password_policy", "key_id")), r.choice([str(r.randint(1, 99999)), f"X-{self.noun().title()}", f"/run/{self.noun()}/{self.noun()}", "${STORE}", f"{self.noun()}-{self.noun()}"])),
                lambda: self.assign(self.tail("passwordLabel"), self.one("Password:", "Enter your password", "Forgot password?", "password", "New password")),
                lambda: f"{self.one('//', '#', ' *')} never put the {self.one('password', 'token', 'api key', 'secret')} in here, read it from the {self.one('vault', 'store', self.noun())}",
                lambda: f"{self.one('//', '#', ' *')} {self.phrase()} {self.one('password', 'token', 'secret', 'api key', 'credentials')} {self.phrase()} {self.one('', self.variable(), self.noun() + str(r.randint(1, 9)))}",
                lambda: f"{self.one('sha1', 'md5', 'rand', 'crc32')} {self.phrase()} {self.one('password', 'secretKey', 'token')}",
                lambda: f"{self.one('Bearer', 'Hosted', 'Generic')} credential: {self.chars(4)}...({r.randint(20, 50)} chars)",
                lambda: f"const {self.noun()} = tokenize{self.noun().title()}({self.noun()}, {r.randint(2, 900)});",
                lambda: f"  {self.noun()}.{self.noun()} = tokenize{self.noun().title()}({self.noun()}.{self.noun()}, '{self.noun()}-{r.randint(1, 99)}');",
                lambda: f"{self.one('connect', 'bind', 'authenticate', 'db.connect')}({self.variable()}, {self.one('options', self.variable())}){self.one(';', '')}",
                lambda: f"{self.one('connect', 'bind', 'button.on')}('{self.one('click', 'change', self.noun())}', {self.variable()});",
                lambda: f"  {self.secret_name()}: process.env.{self.noun().upper()}_{self.one('PASSWORD', 'TOKEN')},\n  '{self.noun()}-{r.randint(1, 9)}': '{self.noun()}-{r.randint(1, 99)}',",
                lambda: self.pem("PUBLIC KEY", False),
                lambda: f"const {self.plain_name()} = '{self.pem('CERTIFICATE', False)}';",
                *[lambda: self.assign(self.other_name(), ident)] * 4,
                *[lambda: self.code()] * 24,
            ]
        )()


def plain_code(lines: int, modules: tuple[str, ...] = tuple(_PLAIN_MODULES)) -> list[str]:
    """At most so many lines of the standard library's own source, a few at a time, evenly over its modules."""
    out: list[str] = []
    each = lines // len(modules) + 1
    for name in modules:
        out += _stretches(name, each)
    return out


def _stretches(module: str, lines: int, rows: int = 4) -> Iterator[str]:
    try:
        spec = importlib.util.find_spec(module)
    except ImportError:
        return
    if spec is None or not spec.origin or not spec.origin.endswith(".py"):
        return
    text = Path(spec.origin).read_text(encoding="utf-8").split("\n")
    step = max(rows, len(text) * rows // max(lines, 1))
    for at in range(0, len(text) - rows, step):
        yield "\n".join(text[at : at + rows])
