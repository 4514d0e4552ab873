"""Clean-up of answers: LaTeX to plain text; marks of web sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# LaTeX commands and the characters that stand for them.
SYMBOLS = (
    (r"\Leftrightarrow", "⇔"), (r"\Rightarrow", "⇒"), (r"\rightarrow", "→"), (r"\leftarrow", "←"), (r"\infty", "∞"), (r"\approx", "≈"),
    (r"\cdots", "..."), (r"\times", "×"), (r"\varphi", "ϕ"), (r"\phi", "φ"), (r"\gamma", "γ"), (r"\lambda", "λ"), (r"\mu", "μ"), (r"\theta", "θ"),
    (r"\sigma", "σ"), (r"\Sigma", "Σ"), (r"\Psi", "Ψ"), (r"\Gamma", "Γ"), (r"\Delta", "Δ"), (r"\delta", "δ"), (r"\neq", "≠"), (r"\leq", "≤"),
    (r"\geq", "≥"), (r"\sim", "~"), (r"\pm", "±"), (r"\cdot", "·"), (r"\alpha", "α"), (r"\beta", "β"), (r"\pi", "π"), (r"\nu", "ν"), (r"\sum", "Σ"),
    (r"\prod", "Π"), (r"\int", "∫"), (r"\to", "→"), (r"\le", "≤"), (r"\ge", "≥"), (r"\quad", " "), (r"\qquad", " "),
)
# Commands whose group stands for itself, escapes, and the mark of a stored web page.
WRAPPERS = ("text", "operatorname", "mathrm", "mathbf", "mathit", "mathbb", "mathcal")
ESCAPES = {r"\{": "{", r"\}": "}", r"\,": " ", r"\;": " ", r"\:": " ", r"\!": "", r"\%": "%", r"\(": "", r"\)": "", r"\[": "", r"\]": "", r"\left": "", r"\right": ""}
MARK = "<!-- study-material-web-source-v1:"


_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[{}^_]|[^\\{}^_]+|\\", re.S)
_MATH = re.compile(r"\$\$(.*?)\$\$|\$(.*?)\$", re.S)
_SPACES = re.compile(r"(?P<none>[ \t]+(?=[，。；：、！？,.!?;:)\n]|\Z)|(?<=[(\n])[ \t]+)|(?P<one>[ \t]+)|\n{3,}")
_READ = dict(SYMBOLS) | ESCAPES


def _groups(tokens: list[str]) -> dict[int, int]:
    """Where each group that ends begins, and its end."""
    open_, ends = [], {}
    for i, token in enumerate(tokens):
        if token == "{":
            open_.append(i)
        elif token == "}" and open_:
            ends[open_.pop()] = i
    return ends


def plain_text(answer: str) -> str:
    """LaTeX as text, in one walk over its tokens with a stack of the groups that are open, however deep."""
    tokens = _TOKEN.findall(_MATH.sub(lambda m: m[1] if m[1] is not None else m[2], answer))
    ends = _groups(tokens)

    def next_group(i: int) -> int | None:
        """The group that begins at token i, but for white space."""
        while i < len(tokens) and tokens[i].isspace():
            i += 1
        return i if i in ends else None

    # of each open group: what it is, what is left of it once it ends, and its text so far
    stack: list[tuple[str, str, list[str]]] = [("all", "", [])]
    i = 0
    while i < len(tokens):
        token, kind, at = tokens[i], None, None
        out, name = stack[-1][2], token[1:] if token[0] == "\\" else token
        if name in WRAPPERS or name == "sqrt" or token in ("^", "_"):
            kind, at = ("script" if token in ("^", "_") else "wrapper" if name in WRAPPERS else "sqrt"), next_group(i + 1)
        elif name in ("frac", "dfrac"):
            kind, at = "numerator", next_group(i + 1)
            at = at if at is not None and next_group(ends[at] + 1) is not None else None
        elif i in ends:
            kind, at = "braces", i
        if at is not None:
            stack.append((kind, token, []))
            i = at + 1
            continue
        if token == "}" and len(stack) > 1:
            kind, mark, parts = stack.pop()
            text, out = "".join(parts), stack[-1][2]
            if kind == "numerator":
                stack.append(("denominator", f"({text})/", []))
                i = next_group(i + 1) + 1
                continue
            if kind == "script":
                text = text.strip()
                text = mark + (text if re.fullmatch(r"[+-]?[^\W_]+", text) else f"({text})")
            out.append({"wrapper": text, "sqrt": f"√({text})", "denominator": f"{mark}({text})", "script": text, "braces": f"{{{text}}}"}[kind])
        else:
            out.append(_READ.get(token, token))
        i += 1
    return _SPACES.sub(lambda m: "" if m["none"] else " " if m["one"] else "\n\n", "".join(stack[0][2]).strip(" \t")).strip()


def plain(answer: Column) -> Column:
    """LaTeX of an answer as text; null stays null."""
    return F.pandas_udf(lambda texts: texts.map(plain_text, na_action="ignore"), "string")(answer)


def residue(answer: Column) -> Column:
    """Whether LaTeX is left in an answer."""
    return answer.rlike(r"\\[A-Za-z]+|\$")


def web_mark(url: Column, title: Column, crawled_at: Column, body: Column) -> Column:
    """The first line of a stored web page: its source as URL-safe base64 of JSON, with the hash of the body."""
    source = F.to_json(F.struct(url.alias("canonical_url"), title.alias("title"), crawled_at.alias("crawled_at"), F.sha2(body, 256).alias("content_sha256")))
    return F.concat(F.lit(MARK), F.rtrim(F.translate(F.base64(source.cast("binary")), "+/\r\n", "-_"), F.lit("=")), F.lit(" -->"))


def web_source(text: Column) -> Column:
    """struct of canonical_url, title, crawled_at and content_sha256 of a stored page; null if it has no mark or the body's hash differs."""
    first = F.substring_index(text, "\n", 1)
    code = F.regexp_extract(first, f"^{MARK}([A-Za-z0-9_-]+) -->$", 1)
    padded = F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    body = F.substring(text, F.length(first) + 2, F.length(text))
    found = F.from_json(F.unbase64(padded).cast("string"), "canonical_url string, title string, crawled_at string, content_sha256 string")
    return F.when((F.length(first) <= 4096) & (code != "") & (found["content_sha256"] == F.sha2(body, 256)), found)


def q_web_marker(spark, sf_dir):
    """Every page with its mark and read back from it; one character more in the body and the mark no longer holds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marked = pages.withColumn("text", F.concat(web_mark(F.col("url"), F.lit("t"), F.lit("2026-01-01T00:00:00Z"), F.col("html")), F.lit("\n"), "html"))
    broken = web_source(F.concat("text", F.lit("x"))).isNull()
    found = marked.select("page_id", web_source(F.col("text")).alias("s"), broken.alias("refused"))
    return found.select("page_id", F.col("s.canonical_url").alias("url"), F.col("s.content_sha256").alias("content_sha256"), "refused")


def q_answer_plain(spark, sf_dir):
    """Each benchmark text, whole and in one line, as a fraction nested in eight groups, read back from LaTeX, and whether any is left."""
    text = F.concat(F.lit(r"$\frac{" + r"\mathrm{" * 8), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("}" * 8 + r"}{\mathbf{"), F.col("item_id").cast("string"), F.lit(r"}} \leq \alpha_{ 1 }$ ."))
    found = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", plain(text).alias("answer"))
    return found.select("item_id", "answer", residue(F.col("answer")).alias("residue"))


QUERIES = {
    "web_marker": (q_web_marker, "select page_id, url, sha256(coalesce(html, '')) as content_sha256, true as refused from pages"),
    "answer_plain": (q_answer_plain, r"select item_id, '(' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ')/(' || item_id || ') ≤ α_1.' as answer, false as residue from benchmark"),
}
