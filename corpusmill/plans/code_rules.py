"""Rules for Rust and TypeScript sources, on comments, strings and lines of code.

Kinds: ``comment`` and ``doc_comment`` and ``string`` rules look at one token,
``code`` rules at a line whose comments and strings are blanked out, ``line`` rules at
a line as it is."""

from __future__ import annotations

from corpusmill.plans.rules import Rule

#: The published shapes of providers' access tokens.
CLOUD_TOKENS = r"\bgh[oprsu]_[A-Za-z0-9]{36}|\bglpat-[A-Za-z0-9_-]{20}|\bAKIA[A-Z0-9]{16}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}"
SCHEMAS = ("**/migrations/**", "**/schema/**")


def _both(id: str, *args, **kw) -> list[Rule]:
    return [Rule(id, *args, language=x, skip_tests=x == "rust", **kw) for x in ("rust", "typescript")]


def _rs(id: str, severity: str, category: str, message: str, pattern: str, kind: str = "code", skip: bool = True, **kw) -> Rule:
    return Rule(id, severity, category, message, language="rust", kind=kind, pattern=pattern, skip_tests=skip, **kw)


def _ts(id: str, severity: str, category: str, message: str, pattern: str, kind: str = "code", **kw) -> Rule:
    return Rule(id, severity, category, message, language="typescript", kind=kind, pattern=pattern, **kw)


CODE_RULES = (
    *_both("open-task", "warning", "correctness", "An open task in a comment", kind="comment", pattern=r"(?i)\b(?:todo|fixme|workaround)\b"),
    *_both("hedged-comment", "warning", "slop", "A comment that isn't sure", kind="comment", pattern=r"(?i)\b(?:hopefully|presumably|somehow|for some reason|no idea (?:why|how))\b"),
    *_both("put-off-work", "warning", "slop", "A comment that puts work off", kind="comment", pattern=r"(?i)\b(?:for now|until (?:we|i) (?:have|find) time|in (?:a|some) later (?:release|version|change))\b"),
    *_both("cloud-token", "error", "security", "A provider's token is spelt out", kind="string", pattern=CLOUD_TOKENS),
    *_both("dash-in-comment", "warning", "slop", "A long dash in a comment", kind="comment", pattern=r"\x{2014}"),
    *_both("dash-in-string", "warning", "slop", "A long dash in a string", kind="string", pattern=r"\x{2014}"),
    _rs("filler-word", "warning", "slop", "A word that says nothing", r"(?i)\b(?:basically|obviously|needless to say|of course|it goes without saying)\b", kind="comment", skip=False),
    _rs("vague-doc", "warning", "slop", "Documentation that trails off", r"(?i)\betc\b|\b(?:things|stuff)\b|\.\.\.\s*$", kind="doc_comment", skip=False),
    _rs("empty-doc", "warning", "slop", "Empty documentation", r"^///\s*$", kind="doc_comment", skip=False, enabled=False),
    _rs("doc-opens-with-kind", "warning", "slop", "Documentation that opens with the kind of thing", r"(?i)^///\s*(?:an?|the|this)\s+(?:struct|enum|trait|function|module|type)\b", kind="doc_comment", skip=False),
    *_both("code-in-comment", "warning", "slop", "Code that is commented out", kind="comment", pattern=r"^//.*[;{}]\s*$", enabled=False),
    *_both("narrating-comment", "warning", "slop", "A comment that narrates what happens", kind="comment", pattern=r"(?i)^//\s*(?:now|then|next|first|finally),?\s+(?:we|it)\b"),
    _rs("float-in-schema", "error", "correctness", "Floating-point columns can't hold money", r"(?i)\b\w*(?:price|amount|total|balance|cost)\w*\s+(?:float|real|double)\b", kind="string", skip=False, files=SCHEMAS),
    _rs("index-not-repeatable", "error", "correctness", "An index that can't be created again", r"(?i)\bcreate\s+(?:unique\s+)?index\b(?!\s+(?:concurrently\s+)?if\b)", kind="string", skip=False, files=SCHEMAS),
    _rs("unwrap", "error", "correctness", "unwrap outside of tests", r"\.unwrap\(\)"),
    _rs("expect", "error", "correctness", "expect outside of tests", r"(?<!lock\(\))(?<!read\(\))(?<!write\(\))\.expect\("),
    _rs("lock-unwrap", "warning", "correctness", "A poisoned lock panics every caller", r"\.(lock|read|write)\(\)\.(unwrap\(\)|expect\()"),
    _rs("ok-then-unwrap", "warning", "correctness", "ok() before unwrapping", r"\bok\(\)\s*\.\s*unwrap\w*\("),
    _rs("two-fallbacks", "warning", "correctness", "A fallback of a fallback", r"\.unwrap_or\w*\([^;]*\)\s*\.unwrap_or\w*\("),
    _rs("dropped-result", "warning", "correctness", "A result is dropped", r"\blet _ = ", unless=r"\.(send|try_send)\("),
    _rs("dropped-error", "warning", "correctness", "The source error is dropped", r"\.map_err\(\s*\|_\w*\|", unless=r"\)\?"),
    _rs("debug-macro", "error", "correctness", "dbg! is left", r"\bdbg!\s*\(", replacement="("),
    _rs("print-macro", "warning", "correctness", "Printing outside of tests", r"\b(println|eprintln)!"),
    _rs("boxed-error", "warning", "correctness", "A boxed error has no context", r"\bBox<dyn\s+(std::error::)?Error"),
    _rs("mutex-in-arc", "warning", "correctness", "A mutex where reads may dominate", r"\bArc<Mutex<", enabled=False),
    _rs("clone-of-new", "warning", "correctness", "A fresh value is cloned", r"\.(to_string|to_owned)\(\)\.clone\(\)"),
    _rs("constant-branch", "warning", "correctness", "A branch that is always or never taken", r"\bif (true|false) \{|\bif (\w+) == \2 \{"),
    _rs("empty-assertion", "warning", "correctness", "An assertion that can't fail", r"\b(debug_)?assert!\(true\)|\b(debug_)?assert_eq!\((\w+), \4\)", skip=False),
    _rs("silenced-dead-code", "error", "security", "Unused code is silenced", r"#!?\[\s*(?:allow|expect)\([^)\]]*\b(?:dead_code|unused)\b", files=("**/src/**",)),
    _rs("client-without-timeout", "error", "security", "A client without a timeout", r"\bClient::new\(\)"),
    _rs("token-checks-off", "error", "security", "Token checks are off", r"\bvalidate_\w+\s*=\s*false\b|\binsecure_disable_signature_validation\b"),
    _rs("hidden-item", "warning", "slop", "A hidden item", r"#\[doc\(hidden\)\]", enabled=False),
    _rs("glob-reexport", "warning", "slop", "Everything is exported again", r"\bpub use [\w:]+::\*;", skip=False, files=("**/src/**/*.rs",)),
    _rs("own-time-format", "warning", "slop", "A time is formatted by hand", r"\.to_rfc3339\(\)"),
    _rs("path-in-line", "warning", "slop", "A long path in the code", r"\b(std|serde|serde_json|chrono|reqwest|tokio|sqlx|base64|url)::\w+::\w+", skip=False, unless=r"^\s*(pub\s+)?use\s|#\[", enabled=False),
    _ts("any-type", "error", "correctness", "any is no type", r"[:<,(|]\s*any\b"),
    _ts("double-cast", "error", "correctness", "A cast by way of unknown", r"\bas unknown as\b"),
    _ts("async-callback", "error", "correctness", "An async callback isn't awaited", r"\.(forEach|map|filter|reduce)\(async\b"),
    _ts("empty-catch", "error", "correctness", "Errors are swallowed", r"\bcatch\s*(\([^)]*\))?\s*\{\s*\}"),
    _ts("plain-sort", "error", "correctness", "Sorting by spelling", r"\.sort\(\)"),
    _ts("thrown-string", "warning", "correctness", "A string is thrown", r"\bthrow\s+[\"'`]"),
    _ts("unexplained-ignore", "warning", "correctness", "Types are ignored for no reason", r"@ts-(?:ignore|nocheck|expect-error)[\s.:-]*$", kind="comment"),
    _ts("constant-branch", "warning", "correctness", "A branch that is always or never taken", r"\bif \((true|false)\)|\bif \((\w+) ===? \2\)"),
    _ts("empty-assertion", "warning", "correctness", "An assertion that can't fail", r"\bexpect\(true\)\.toBe\(true\)|\.toBeDefined\(\)"),
    _ts("local-mock", "warning", "correctness", "A module of one's own is mocked", r"\b(jest|vi)\.mock\(\s*['\"]\.", kind="line"),
    _ts("unknown-alias", "error", "correctness", "A type that says unknown", r"\btype\s+\w+\s*=\s*unknown\b|\bRecord<string,\s*unknown>"),
    _ts("evaluated-text", "error", "security", "Text is evaluated", r"(?<![\w.])eval\("),
    _ts("query-by-text", "error", "security", "A query is put together from text", r"`[^`]*\b(SELECT|INSERT|UPDATE|DELETE)\b[^`]*\$\{", kind="line"),
    _ts("shell-by-text", "error", "security", "A command is put together from text", r"\bexec(Sync)?\(\s*`[^`]*\$\{", kind="line"),
    _ts("reflected-call", "warning", "slop", "A call by reflection", r"\bReflect\.(apply|get)\("),
    *[Rule("long-file", "warning", "slop", "$value lines of code in a file", language=x, metric="code_lines", threshold=500, skip_tests=True) for x in ("rust", "typescript")],
    *[Rule("many-functions", "warning", "slop", "$value functions in a file", language=x, metric="function_count", threshold=30, skip_tests=True) for x in ("rust", "typescript")],
    *[Rule("many-imports", "warning", "slop", "$value imports in a file", language=x, metric="import_count", threshold=40, skip_tests=True) for x in ("rust", "typescript")],
    *[Rule("mostly-comments", "warning", "slop", "Comments make up $value of a file", language=x, metric="comment_ratio", threshold=0.4, min_lines=25, skip_tests=True) for x in ("rust", "typescript")],
)
