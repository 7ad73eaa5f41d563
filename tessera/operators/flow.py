"""What a function does with untrusted data, for languages of braces and Ruby, from a lexer and a table of names.

A text is read once. Statements follow each other; a function has a state of its own, name -> value, where a value is the
sinks that each of its origins is cleaned for. Origins are symbolic: 'source', 'param:i' for a parameter and 'ret:f' for what a function
f gives back, so no text is read twice however deep calls go: taint.resolve() joins the events of all functions. After a
block the state is the union of what holds with and without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

COMMAND, SQL, PATH, BUFFER, FORMAT = "sast/taint-command-exec", "sast/taint-sql", "sast/taint-path", "sast/taint-buffer", "sast/taint-format-string"
#: origin -> rules that the value is clean of as far as it comes from there
Value = dict[str, frozenset]
NONE: Value = {}
SOURCE: Value = {"source": frozenset()}


@dataclass(frozen=True)
class Language:
    """sinks: rule -> (last names, parts of the whole name, whole names); all in lower case."""

    sources: tuple[str, ...]
    sinks: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]]
    newline: bool = False
    typed_first: bool = False
    hashes: bool = False


#: Where untrusted data comes from and what is dangerous to reach, by language.
_JS = Language(
    ("req.body", "req.query", "req.params", "req.headers", "req.cookies", "req.url", "req.originalUrl", "request.body", "request.query", "request.params", "ctx.query", "ctx.request", "process.env", "location.search", "location.hash", "location.href", "document.location", "document.referrer", "window.name"),
    {COMMAND: ((), ("vm.runin", "child_process.exec", "child_process.execsync", "child_process.spawn", "child_process.spawnsync", "child_process.execfile", "child_process.execfilesync"), ("eval", "window.eval", "globalthis.eval", "self.eval", "global.eval", "function", "window.function", "globalthis.function", "self.function", "global.function")),
     SQL: (("query", "execute"), (), ()), PATH: (("sendfile",), ("fs.readfile", "fs.createreadstream", "fs.writefile", "fs.appendfile", "fs.open"), ())}, newline=True)
_JDBC = ("executequery", "executeupdate", "execute", "preparestatement")
_C = Language(
    ("getenv", "std::getenv"),
    {COMMAND: (("system", "popen", "execl", "execlp", "execle", "execv", "execvp", "execvpe"), (), ()), SQL: (("mysql_query", "mysql_real_query", "sqlite3_exec", "pqexec"), (), ()), PATH: (("fopen", "freopen", "open", "open64"), (), ()),
     BUFFER: (("strcpy", "strcat", "sprintf", "vsprintf", "stpcpy", "memcpy", "memmove", "strncpy", "strncat", "snprintf", "vsnprintf", "bcopy", "wcscpy", "wcscat"), (), ()),
     FORMAT: (("printf", "fprintf", "syslog", "vprintf", "vfprintf", "dprintf", "err", "warn"), (), ())}, typed_first=True)
LANGUAGES: dict[str, Language] = {
    "javascript": _JS, "typescript": _JS, "c": _C, "cpp": _C,
    "go": Language(
        (".URL.Query", ".URL.RawQuery", ".FormValue", ".PostFormValue", ".URL.Path", ".Form", ".PostForm", ".Body", ".Header.Get", ".Cookie", "mux.Vars", "os.Getenv"),
        {COMMAND: ((), ("exec.command",), ()), SQL: (("query", "exec", "queryrow", "querycontext", "execcontext", "queryrowcontext"), (), ()), PATH: ((), ("os.open", "os.readfile", "os.create", "os.readdir", "ioutil.read"), ())}, newline=True),
    "java": Language(
        (".getParameter", ".getParameterValues", ".getParameterMap", ".getHeader", ".getHeaders", ".getQueryString", ".getCookies", ".getInputStream", ".getReader", ".getPathInfo", ".getRequestURI", ".getRequestURL", "System.getenv", "System.getProperty"),
        {COMMAND: (("processbuilder", "exec"), (), ()), SQL: (_JDBC, (), ()), PATH: (("file", "fileinputstream", "fileoutputstream", "filereader", "randomaccessfile", "readallbytes", "readalllines", "readstring", "lines", "newinputstream", "newbufferedreader"), (), ())}, typed_first=True),
    "ruby": Language(
        ("params[", "params.", "cookies[", "ENV[", "request.params", "request.body", "request.GET", "request.POST", "request.query_parameters", "request.env", "request.path", "request.url", "request.referer"),
        {COMMAND: (("system", "exec", "popen", "popen3", "spawn", "capture2", "capture3"), (), ("eval",)), SQL: (("execute", "exec_query"), (), ()), PATH: ((), ("file.open", "file.read", "file.readlines", "file.foreach", "file.binread", "io.open", "io.read", "io.readlines", "io.foreach", "io.binread"), ("open",))}, newline=True, hashes=True),
    "php": Language(
        ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES", "php://input", "getenv", "apache_request_headers"),
        {COMMAND: (("system", "exec", "shell_exec", "passthru", "popen", "proc_open"), (), ()), SQL: (("mysqli_query", "query", "pg_query", "pg_exec"), (), ()), PATH: (("fopen", "file_get_contents", "file_put_contents", "readfile", "fread", "fgets", "opendir", "scandir", "simplexml_load_file"), (), ())}, hashes=True),
    "csharp": Language(
        ("Request.QueryString", "Request.Query", "Request.Form", "Request.Params", "Request.Headers", "Request.Cookies", "Request.Body", "Request.Files", "Request.RawUrl", "Environment.GetEnvironmentVariable"),
        {COMMAND: (("process", "processstartinfo"), ("process.start",), ()), SQL: (("sqlcommand", "mysqlcommand", "npgsqlcommand", "sqlitecommand", "oledbcommand", "executesqlraw", "executesqlrawasync", "fromsqlraw"), (), ()),
         PATH: (("streamreader", "streamwriter", "filestream"), ("file.readalltext", "file.readallbytes", "file.readalllines", "file.open", "file.openread", "file.opentext", "file.writealltext", "file.writeallbytes"), ())}, typed_first=True),
    "rust": Language(
        ("env::var", ".query_string", ".query_pairs", "web::Query", "web::Path", "web::Form", ".headers("),
        {COMMAND: ((), ("command::new",), ()), SQL: ((), ("sqlx::query", "sql_query"), ()), PATH: ((), ("file::open", "fs::read", "fs::write"), ())}),
    "kotlin": Language(
        ("call.parameters", ".queryParameters", ".formParameters", ".receiveText", ".receive(", ".getParameter", ".getHeader", ".getStringExtra", ".getExtras", "System.getenv"),
        {COMMAND: (("exec", "processbuilder"), (), ()), SQL: (_JDBC, (), ()), PATH: (("file", "fileinputstream", "filereader", "readtext", "readbytes", "readlines"), (), ())}, newline=True),
    "scala": Language(
        (".getQueryString", ".queryString", ".rawQueryString", "request.body", ".getParameter", ".getHeader", ".headers", ".cookies", "sys.env"),
        {COMMAND: (("exec", "process"), (), ()), SQL: (("sql", *_JDBC), (), ()), PATH: (("fromfile", "file", "fileinputstream"), (), ())}, newline=True),
    "swift": Language(
        (".query", "req.parameters", "req.content", ".queryParameters", ".headers", "ProcessInfo", ".environment"),
        {COMMAND: (("system", "popen", "launch"), ("process",), ()), SQL: (("prepare", "run", "scalar", "execute", "raw"), (), ()), PATH: (("contentsoffile",), ("filehandle",), ())}, newline=True),
    "dart": Language(
        (".queryParameters", "request.headers", ".requestedUri", "request.url", "Platform.environment", "request.context"),
        {COMMAND: ((), ("process.run", "process.start"), ()), SQL: (("rawquery", "rawinsert", "rawupdate", "rawdelete", "execute"), (), ()), PATH: (("file", "readasstring", "readasbytes", "readaslines", "open"), (), ())}, typed_first=True),
}
#: What makes data safe, by last name or by a part of the whole name, and for which sinks.
NUMERIC = ("int", "float", "atoi", "atol", "atof", "strtol", "strtoul", "strtod", "itoa", "parseint", "parsefloat", "number", "bool", "intval", "floatval", "toint32", "toint64", "toint16", "todouble", "tosingle")
CLEANERS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    COMMAND: (("escapeshellarg", "escapeshellcmd"), ("shlex.quote",)),
    SQL: (("escapesql", "mysqli_real_escape_string", "real_escape_string", "quote_ident", "quote_literal", "addslashes"), ()),
    "sast/taint-xss": (("escape", "escapestring", "escapehtml", "escapehtml4", "htmlescape", "jsescape", "htmlescapestring", "html_escape", "escape_for_html", "encodeuricomponent", "encodeuri", "htmlspecialchars", "htmlentities", "htmlencode", "urlencode", "escapedatastring", "escapeuristring", "sanitize", "clean"),
                       ("markupsafe.escape", "dompurify.sanitize", "validator.escape", "stringescapeutils", "escapeutils", "re.escape")),
    PATH: (("basename", "realpath", "canonicalize", "normpath", "abspath"), ()),
}
ALLOC = "sast/taint-alloc-size"
#: A number is safe everywhere but as a size.
ALL_BUT_SIZE = "all"
#: Rules for which any argument counts, whatever its place.
WHOLE = (COMMAND, BUFFER, "sast/taint-dynamic-exec", "sast/taint-xpath", "sast/taint-ldap", "sast/taint-xss")
#: Calls that fill a buffer with input, and the first argument that is one.
FILLS = {"scanf": 1, "sscanf": 2, "fscanf": 2, "gets": 0, "fgets": 0, "fread": 0, "read": 1, "recv": 1, "recvfrom": 1}
#: Methods that hand what their argument holds to the receiver.
MUTATORS = ("append", "push", "push_str", "add", "insert", "extend", "put", "addall", "concat", "write", "set", "unshift", "merge", "update")
PII = ("passport", "snils", "inn", "ssn", "birthdate")
#: Calls that are dangerous by the shape of their arguments, by last name.
EXECUTES, QUERIES, LOADS = ("system", "popen", "execsync", "execfile", "spawnsync"), ("execute", "query", "rawquery", "executequery", "prepare"), ("load", "full_load", "unsafe_load", "load_all", "loads")
MASKS = ("mask", "redact", "anonym", "hash(")
CONTROL = ("if", "for", "while", "switch", "catch", "else", "do", "try", "foreach", "when", "match", "using", "lock", "synchronized", "unless", "guard", "elsif", "case", "with", "defer", "loop")
TOKEN = re.compile(
    r"""(?P<skip>[ \t\r]+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|<\?php|\?>)|(?P<nl>\n)|(?P<str>[$@rbf]{0,2}(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`))"""
    r"""|(?P<chain>(?:\.|->|::|\?\.|!\.|!!\.)?[$@]{0,2}[A-Za-z_]\w*(?:(?:\.|->|::|\?\.)[$@]?[A-Za-z_]\w*)*)|(?P<num>\d[\w.]*)|(?P<op>:=|=>|===?|!==?|<=|>=|\+=|-=|\.=|\|\|=|\?\?=|&&|\|\||->|<-|::|[-+*/%&|^~!?:;,.=<>(){}\[\]\\#@$])"""
)
PARTS = re.compile(r"\$\{([^}]*)\}|#\{([^}]*)\}|\\\(([^)]*)\)|(\$[A-Za-z_]\w*)|\{\s*\$?([A-Za-z_][\w.]*)\s*[}:]")


@dataclass
class Token:
    kind: str
    text: str
    line: int


def lex(text: str, language: Language) -> list[Token]:
    if language.hashes:
        text = re.sub(r"(?m)(^|\s)#(?!\{)[^\n]*", r"\1", text)
    out, line = [], 1
    for m in TOKEN.finditer(text):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


def joined(parts: list[Value]) -> Value:
    """All origins of the parts, each clean of what it is clean of wherever it stands."""
    out: Value = {}
    for p in parts:
        for o, clean in p.items():
            out[o] = out[o] & clean if o in out else clean
    return out


def cleaned_for(full: str, leaf: str) -> frozenset:
    if leaf in NUMERIC:
        return frozenset({ALL_BUT_SIZE})
    for rule, (leaves, parts) in CLEANERS.items():
        if leaf in leaves or any(p in full for p in parts):
            return frozenset({rule})
    return frozenset()


def sink_of(language: Language, full: str, leaf: str) -> str | None:
    for rule, (leaves, parts, names) in language.sinks.items():
        if leaf in leaves or full in names or any(p in full for p in parts):
            return rule
    return None


def unsafe_load(full: str, leaf: str) -> bool:
    """Whether a call, in lower case, may build any object from data."""
    return any(p in full for p in ("pickle.load", "marshal.load", "unserialize")) or full.endswith("objectinputstream") or ("yaml" in full and leaf in LOADS)


def personal(name: str) -> bool:
    tokens = [t.lower() for t in re.findall(r"[A-Z]?[^A-Z_.$>:-]+|[A-Z]+", name)]
    return any(t in PII for t in tokens) or any(a + b == "birthdate" for a, b in zip(tokens, tokens[1:], strict=False))


def last_of(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1]


def leaf_of(name: str) -> str:
    return last_of(name).lower()


@dataclass
class Scope:
    name: str
    state: dict[str, Value]
    freed: set[str] = field(default_factory=set)
    last: Value = field(default_factory=dict)


class Reader:
    """Reads one text; `events` are (func, kind, line_no, origin, rule, callee, arg, clean)."""

    def __init__(self, lang: str, text: str) -> None:
        self.lang, self.language = lang, LANGUAGES[lang]
        self.tokens = lex(text, self.language)
        self.events: list[tuple] = []
        self.scopes = [Scope("", {})]
        self.blocks: list[dict | None] = []

    @property
    def scope(self) -> Scope:
        return self.scopes[-1]

    def emit(self, kind: str, line: int, value: Value, rule: str | None = None, callee: str | None = None, arg: int | None = None) -> None:
        for o in sorted(value):
            self.events.append((self.scope.name, kind, line, o, rule, callee, arg, sorted(value[o])))

    def is_source(self, text: str) -> bool:
        for s in self.language.sources:
            at = text.find(s)
            if at >= 0 and (s[0] in ".$" or at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (not s[-1].isalnum() or at + len(s) == len(text) or not (text[at + len(s)].isalnum() or text[at + len(s)] == "_")):
                return True
        return False

    def close(self, i: int, end: int) -> int:
        """The place of the bracket that closes the one at i."""
        depth = 0
        for j in range(i, end):
            t = self.tokens[j].text
            if self.tokens[j].kind == "op":
                depth += t in "([{" and len(t) == 1
                depth -= t in ")]}" and len(t) == 1
            if not depth:
                return j
        return end

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        out, start, i = [], a, a
        while i < b:
            t = self.tokens[i]
            if t.kind == "op" and t.text in ("(", "[", "{"):
                i = self.close(i, b)
            elif t.kind == "op" and t.text == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        return [*out, (start, b)] if start < b else out

    def variable(self, name: str) -> Value:
        state, parts = self.scope.state, re.split(r"(?:\.|->|::|\?\.)", name)
        if name in state:
            return state[name]
        return joined([state[n] for n in {parts[0], parts[0].lstrip("$@")} if n in state])

    def value(self, a: int, b: int) -> Value:
        """Origins of an expression; the calls within are looked at on the way."""
        parts, i, tokens = [], a, self.tokens
        if b - a > 4 and tokens[a].text in ("true", "false") and tokens[a + 1].text == "?":  # a constant picks its branch
            colon = next((j for j in range(a, b) if tokens[j].text == ":"), b)
            return self.value(a + 2, colon) if tokens[a].text == "true" else self.value(colon + 1, b)
        held, full = NONE, ""
        while i < b:
            t = tokens[i]
            if t.kind == "chain":
                after = tokens[i + 1].text if i + 1 < b else ""
                linked = t.text[0] in ".-:?!" and bool(full)
                full = full + re.sub(r"^(?:\?|!!?)", "", t.text) if linked else t.text
                if not linked:
                    parts.append(held)
                    held = NONE
                if self.is_source(full + (after if after in ("(", "[") else "")):
                    held = SOURCE
                elif not linked:
                    held = self.variable(t.text)
                if after == "(":
                    end = self.close(i + 1, b)
                    held = self.call(full, self.split(i + 2, end), held, t.line)
                    i = end
                elif self.lang == "ruby" and not linked and after and i + 1 < b and tokens[i + 1].kind in ("chain", "str") and sink_of(self.language, full.lower(), leaf_of(full)):
                    held = self.call(full, self.split(i + 1, b), held, t.line)
                    i = b
            elif t.kind == "str":
                parts.append(held)
                held, full = joined([self.inner(x) for m in PARTS.findall(t.text) for x in m if x]), ""
                if any(s in t.text for s in self.language.sources if s.startswith("php:")):
                    held = SOURCE
            elif t.kind == "op" and t.text in ("(", "[", "{"):
                end = self.close(i, b)
                inside = joined([self.value(x, y) for x, y in self.split(i + 1, end)])
                if t.text == "[" and full:
                    held = joined([held, inside])
                else:
                    parts.append(held)
                    held, full = inside, ""
                i = end
            elif t.kind == "op" and t.text in ("!", "?") and full and i + 1 < b and tokens[i + 1].text[0] in ".;)" :
                pass
            else:
                parts.append(held)
                held, full = NONE, ""
            i += 1
        return joined([*parts, held])

    def inner(self, text: str) -> Value:
        """What is put into a string."""
        out = []
        for m in re.finditer(r"[$@]?[A-Za-z_][\w.]*\[?", text):
            name = m[0].rstrip("[")
            out.append(SOURCE if self.is_source(m[0]) else joined([self.variable(name), self.variable("$" + name)]))
        return joined(out)

    def call(self, full: str, args: list[tuple[int, int]], receiver: Value, line: int) -> Value:
        low, leaf, named = full.lower(), leaf_of(full), last_of(full).lstrip("$@")
        values = [self.value(x, y) for x, y in args]
        self.events.append((self.scope.name, "call", line, "", None, named, len(args), []))
        for shape in self.shapes(low, leaf, args):
            self.events.append((self.scope.name, "shape", line, "", shape, None, None, []))
        rule = sink_of(self.language, low, leaf)
        if rule:
            at = 0
            if rule == FORMAT and leaf in ("fprintf", "syslog", "dprintf", "vfprintf") or self.lang == "go" and rule == SQL and leaf.endswith("context"):
                at = 1
            whole = rule in WHOLE or (rule == SQL and self.lang in ("php", "c", "cpp"))
            for v in values if whole else values[at : at + 1]:
                self.reach(rule, v, line)
            if rule == PATH:
                self.reach(rule, receiver, line)
        for i, v in enumerate(values):
            if v:
                self.emit("pass", line, v, callee=named, arg=i)
        if self.lang in ("c", "cpp"):
            self.memory(leaf, args, values, line)
        if ("log" in low or "console." in low or low.startswith(("print", "fmt."))) and any(personal(t.text) for x, y in args for t in self.tokens[x:y] if t.kind == "chain") and not any(m in "".join(t.text for x, y in args for t in self.tokens[x:y]).lower() for m in MASKS):
            self.events.append((self.scope.name, "finding", line, "source", "pdn-log-dynamic", None, None, []))
        base = re.split(r"\.|->|::|\?\.", full)[0]
        if leaf in MUTATORS and base != full:
            got = joined([*values, self.scope.state.get(base, NONE)])
            if got:
                self.scope.state[base] = got
        if receiver == SOURCE and self.is_source(full + "("):
            return receiver
        out = joined([*values, receiver])
        clean = cleaned_for(low, leaf)
        return {o: c | clean for o, c in out.items()} if clean else joined([out, {f"ret:{named}": frozenset()}])

    def shapes(self, low: str, leaf: str, args: list[tuple[int, int]]) -> Iterator[str]:
        """Structural rules that a call breaks, whatever its data."""
        if leaf in EXECUTES and args:
            x, y = args[0]
            found = [t for t in self.tokens[x:y] if t.kind != "nl"]
            if any(t.kind == "chain" and t.text not in ("true", "false", "nil", "null", "None", "nullptr") for t in found) or any(t.kind == "str" and any(map(any, PARTS.findall(t.text))) for t in found):
                yield "sast/dynamic-exec"
        if leaf in QUERIES and any(self.built(x, y) for x, y in args):
            yield "sast/sql-injection"
        if unsafe_load(low, leaf) and not any(s in "".join(t.text for x, y in args for t in self.tokens[x:y]).lower() for s in ("safeloader", "baseloader")):
            yield "sast/unsafe-deserialize"

    def built(self, a: int, b: int) -> bool:
        """Whether an argument is a string put together with something that is no constant."""
        found = self.tokens[a:b]
        text, names = [t for t in found if t.kind == "str"], any(t.kind == "chain" for t in found)
        glued = any(t.kind == "op" and t.text in ("+", ".", "%") for t in found)
        return bool(text) and ((glued and names) or any(any(map(any, PARTS.findall(t.text))) for t in text if not (self.lang in ("go", "java", "c", "cpp", "rust") or t.text.startswith("'") and self.lang in ("javascript", "typescript", "php", "ruby"))))

    def reach(self, rule: str, value: Value, line: int) -> None:
        self.emit("sink", line, {o: c for o, c in value.items() if rule not in c and (ALL_BUT_SIZE not in c or rule == ALLOC)}, rule)

    def memory(self, leaf: str, args: list[tuple[int, int]], values: list, line: int) -> None:
        names = [next((t.text for t in self.tokens[x:y] if t.kind == "chain"), "") for x, y in args]
        if leaf in FILLS:
            for n in names[FILLS[leaf] :] if leaf.endswith("scanf") else names[FILLS[leaf] : FILLS[leaf] + 1]:
                self.scope.state[n] = SOURCE
        if leaf == "free":
            if names and names[0] in self.scope.freed:
                self.events.append((self.scope.name, "finding", line, "source", "sast/double-free", None, None, []))
            elif names:
                self.scope.freed.add(names[0])
            return
        for n in names:
            if n in self.scope.freed:
                self.events.append((self.scope.name, "finding", line, "source", "sast/use-after-free", None, None, []))
        if leaf in ("malloc", "calloc", "realloc", "alloca"):
            for v in values[1:2] if leaf == "realloc" else values:
                self.reach(ALLOC, v, line)

    def statement(self, a: int, b: int) -> None:
        while a < b and self.tokens[a].kind == "nl":
            a += 1
        if a >= b:
            return
        tokens, depth, at = self.tokens, 0, None
        for i in range(a, b):
            t = tokens[i]
            if t.kind == "op":
                depth += t.text in ("(", "[", "{")
                depth -= t.text in (")", "]", "}")
                if not depth and t.text in ("=", ":=", "+=", ".=", "||=", "??=", "<-"):
                    at = i
                    break
        if at is None or tokens[a].text in CONTROL:
            got = self.value(a + (tokens[a].text == "return"), b)
            self.scope.last = got
            if tokens[a].text == "return":
                self.emit("returns", tokens[a].line, got)
            return
        got = self.value(at + 1, b)
        left = [t for t in tokens[a:at] if t.kind in ("chain", "op")]
        colon = next((k for k, t in enumerate(left) if t.text == ":"), len(left))
        # Commas part several targets; brackets and what is in them name a place within one.
        depth, targets, place = 0, [], False
        for t in left[:colon]:
            if t.text in ("[", "("):
                depth, place = depth + 1, place or t.text == "["
            elif t.text in ("]", ")"):
                depth -= 1
            elif t.kind == "chain" and not (depth and place):
                targets.append(t.text)
        several = any(t.text == "," for t in left[:colon])
        for name in targets if several else targets[-1:]:
            keep = tokens[at].text in ("+=", ".=") or place
            self.scope.state[name] = joined([got, self.scope.state.get(name, NONE)]) if keep else got
            self.scope.freed.discard(name)

    def parameters(self, a: int, b: int) -> list[str]:
        out = []
        for x, y in self.split(a, b):
            names = [t for t in self.tokens[x:y] if t.kind == "chain"]
            colon = next((k for k in range(x, y) if self.tokens[k].text == ":"), None)
            before = [t for t in self.tokens[x:colon] if t.kind == "chain"] if colon is not None else names
            if before:
                out.append((before[-1] if colon is not None or self.language.typed_first or self.lang == "php" else before[0]).text)
        return out

    def header(self, a: int, b: int) -> tuple[str, list[str]] | None:
        """Name and parameters, if the statement before a block is the head of a function."""
        i = a
        while i < b and self.tokens[i].kind == "nl":
            i += 1
        while i + 1 < b and self.tokens[i].text == "#" and self.tokens[i + 1].text == "[":  # attributes
            i = self.close(i + 1, b) + 1
            while i < b and self.tokens[i].kind == "nl":
                i += 1
        if i >= b or self.tokens[i].text in (*CONTROL, "class", "struct", "interface", "enum", "impl", "namespace", "object", "module", "mod", "trait", "union", "protocol", "extension", "return", "}"):
            return None
        found, start = None, i - a
        while i < b:
            t = self.tokens[i]
            if t.kind == "op" and t.text == "=" and self.tokens[a + start].text not in ("def", "fun", "override", "private", "public", "suspend"):
                found = None
            if t.kind == "op" and t.text == "(":
                end = self.close(i, b)
                named = self.tokens[i - 1] if i > a and self.tokens[i - 1].kind == "chain" else None
                if named is not None and named.text in CONTROL:
                    return None
                if named is not None and (found is None or found[0] == "func"):
                    found = (named.text, self.parameters(i + 1, end))
                i = end
            i += 1
        return found

    def read(self) -> list[tuple]:
        tokens, n, start, i = self.tokens, len(self.tokens), 0, 0
        while i < n:
            t = tokens[i]
            if t.kind == "op" and t.text in ("(", "["):
                i = self.close(i, n)
            elif self.lang == "ruby" and t.kind == "chain" and t.text == "def" and (i == start or tokens[i - 1].kind == "nl"):
                end = next((j for j in range(i, n) if tokens[j].kind == "nl"), n)
                bracket = next((j for j in range(i, end) if tokens[j].text == "("), None)
                params = self.parameters(bracket + 1, self.close(bracket, end)) if bracket is not None else []
                self.leave()
                self.enter(last_of(tokens[i + 1].text) if i + 1 < n else "", params, t.line)
                i = end
                start = i + 1
            elif t.kind == "op" and t.text == "{" and self.lang != "ruby":
                head = self.header(start, i)
                if head:
                    self.enter(last_of(head[0]), head[1], t.line)
                    self.blocks.append(None)
                elif start < i and tokens[i - 1].kind == "op" and tokens[i - 1].text in ("=", ":=", "(", ",", ":", "return", "=>"):
                    i = self.close(i, n)  # a literal within a statement
                    i += 1
                    continue
                else:
                    self.statement(start, i)
                    self.blocks.append(dict(self.scope.state))
                start = i + 1
            elif t.kind == "op" and t.text == "}" and self.lang != "ruby":
                self.statement(start, i)
                start = i + 1
                before = self.blocks.pop() if self.blocks else {}
                if before is None:
                    self.leave()
                elif before:
                    names = set(before) | set(self.scope.state)
                    self.scope.state = {k: joined([before.get(k, NONE), self.scope.state.get(k, NONE)]) for k in names}
            elif (t.kind == "op" and t.text == ";") or (t.kind == "nl" and self.language.newline and not (i + 1 < n and tokens[i + 1].text[0] in ".?" and tokens[i + 1].kind == "chain")):
                self.statement(start, i)
                start = i + 1
            i += 1
        self.statement(start, n)
        self.leave()
        return self.events

    def enter(self, name: str, params: list[str], line: int) -> None:
        self.events.append((name, "def", line, "", None, None, len(params), []))
        self.scopes.append(Scope(name, {p: {f"param:{i}": frozenset()} for i, p in enumerate(params)}))

    def leave(self) -> None:
        if len(self.scopes) > 1:
            if self.lang in ("ruby", "rust", "kotlin", "scala"):
                self.emit("returns", 0, self.scope.last)
            self.scopes.pop()
