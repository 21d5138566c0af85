"""Generated, minified, vendored and data files among source files, by grammars over their tokens.

Each file's tokens are compressed by Re-Pair: the most frequent pairs of neighbours become rules
until no pair repeats often enough. How much of the file its rules absorb, and how often they are
reused, tells generated code; literals that take most of the text and whose characters Re-Pair hardly
shortens tell data; long lines of short names tell minified code. Passages are also parsed into rules whose names
depend on their content only, so that equal passages have equal rules in every file; rules found
in several repositories tell vendored copies, also patched ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, salted_join, spread
from cipherledger.functions.text import plain_path

TOKEN = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|(0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([A-Za-z_$][\w$]*)|([^\s\w])""")
DIGITS = re.compile(r"\d+")
#: Literals must take so much of a file that is data.
DATA_SHARE = 0.7
COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|<!--|;)")

# What generators write into a file's leading comment, in several languages. "Do not edit" alone counts only
# where it ends its sentence: own files forbid the change of one part.
GENERATED_MARK = re.compile(
    r"code generated by|auto[- ]?generated by|<auto-generated|@generated|automatically (?:created|generated) (?:from|by)|generated by the protocol buffer|this file (?:was|is) (?:auto)?generated"
    r"|do not (?:edit|modify)(?: this file| by hand| manually| directly)*\s*(?:[.!*]|-->|$)|(?:will be lost|overwritten)[^\n]*(?:regenerat|$)|manual changes? (?:is|are|will be) (?:overwritten|lost)"
    r"|(?:automatisch )?(?:erzeugt|generiert) (?:von|aus) |nicht (?:von hand|manuell) (?:ändern|bearbeiten)|généré(?: automatiquement)? (?:par|à partir)|ne pas modifier"
    r"|generado(?: automáticamente)? (?:por|a partir)|no (?:editar|modificar) (?:a mano|manualmente)|gerado(?: automaticamente)? (?:por|a partir)|não editar|gegenereerd (?:door|uit)|niet (?:handmatig )?bewerken",
    re.I | re.M,
)
#: A licence alone tells nothing about whose file it is; it counts beside a passage that other repositories have, too.
LICENCE_MARK = re.compile(r"SPDX-License-Identifier|licensed under the (?:MIT|Apache|BSD)", re.I)
VENDOR_MARK = re.compile(r"\(c\) \d{4}[^\n]* Authors|this file is part of|released under the [\w .-]+ licen[cs]e", re.I)
# Directories that hold generated or third-party files whatever their names.
GENERATED_PATH = re.compile(r"(?:^|/)(?:build/gen|generated|gen-src|__generated__|autogen)/|\.designer\.\w+$|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$|\.g\.(?:cs|dart)$", re.I)
VENDOR_PATH = re.compile(r"(?:^|/)(?:node_modules|third[_-]?party|externals?|bower_components|site-packages|Pods)/|(?:^|/)vendor/[\w.@-]+?-v?\d+(?:\.\d+)+/|(?:^|/)vendor/(?:github\.com|golang\.org)/", re.I)
MINIFIED_PATH = re.compile(r"\.min\.(?:js|css)$|\.bundle\.js$|\.chunk\.js$", re.I)
SHEET = re.compile(r"\.(?:css|scss|less)$", re.I)
CONFIG = re.compile(r"\.(?:json|ya?ml|env|properties|toml|ini|cfg|conf|xml)$", re.I)


def re_pair(tokens: np.ndarray, least: int = 3) -> tuple[int, int, int]:
    """(length of the final sequence, number of rules, uses of the rules) of a Re-Pair grammar.

    Rounds replace, without overlaps, every pair of neighbours that is at least half as frequent as
    the most frequent one, until no pair occurs `least` times.
    """
    seq = tokens.astype(np.int64)
    fresh, rules, uses = int(seq.max()) + 1 if len(seq) else 0, 0, 0
    while len(seq) > 3:
        pair = seq[:-1] * (fresh + 1) + seq[1:]
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(pair)))
        inverse = np.empty(len(pair), dtype=np.int64)
        inverse[order] = np.repeat(np.arange(len(first)), counts)
        top = counts.max()
        if top < least:
            break
        picked = counts >= max(least, (top + 1) // 2)
        # left to right without overlaps: of a run of neighbouring hits every second one counts
        hit = picked[inverse]
        start = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
        run = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit)))) if len(start) and start[0] == 0 else None
        if run is None:
            head = np.zeros(len(hit), dtype=np.int64)
            head[start] = start
            run = np.arange(len(hit)) - np.maximum.accumulate(head)
        take = np.flatnonzero(hit & (run % 2 == 0))
        used = np.zeros(len(first), dtype=np.int64)
        used[inverse[take]] = 1
        seq = seq.copy()
        seq[take] = fresh + np.cumsum(used)[inverse[take]] - 1
        keep = np.ones(len(seq), dtype=bool)
        keep[take + 1] = False
        seq = seq[keep]
        made = int(used.sum())
        rules, uses, fresh = rules + made, uses + len(take), fresh + made
    return len(seq), rules, uses


def passages(lines: list[str], levels: int = 2) -> list[tuple[int, int]]:
    """(rule name, lines covered) of a locally consistent grammar over the file's lines.

    The terminals are hashes of lines without white space; a rule ends where the hash is smaller
    than its neighbours', so equal passages are cut alike wherever they stand; its name is the
    hash of what it covers. Each level does this over the rules of the level below; those of the
    last level, which together cover the file once, are returned.
    """
    symbols = [(zlib.crc32(x.encode()) | (zlib.adler32(x.encode()) << 32), 1) for x in ("".join(s.split()) for s in lines) if len(x) > 2]
    for _ in range(levels):
        grouped, part = [], []
        for i, s in enumerate(symbols):
            part.append(s)
            left = symbols[i - 1][0] if i else 1 << 63
            right = symbols[i + 1][0] if i + 1 < len(symbols) else 1 << 63
            if s[0] < left and s[0] <= right or i + 1 == len(symbols):
                text = ",".join(str(h) for h, _ in part).encode()
                grouped.append((zlib.crc32(text) | (zlib.adler32(text) << 32), sum(n for _, n in part)))
                part = []
        symbols = grouped
    return symbols


def literal_ratio(text: str) -> float:
    """Size of the Re-Pair grammar of a text's characters, in bits, as a share of the text's: near-incompressible texts stay large."""
    if len(text) <= 200:
        return 0.0
    codes = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)[1]
    left, rules, _ = re_pair(codes)
    return float((left + 2 * rules) * np.log2(codes.max() + 1 + rules) / (8 * len(codes))) if codes.max() else 0.0


def file_traits(content: str, path: str) -> dict:
    """Features of one file: its Re-Pair grammar, literals, lines and marks."""
    number_of: dict[str, int] = {}
    ids: list[int] = []
    literal, names, name_len = [], 0, 0
    for text, number, name, other in TOKEN.findall(content):
        if name:
            names += 1
            name_len += len(name)
            if len(name) >= 40:
                literal.append(name)
                other = "S"
            else:
                other = name if name.isalpha() else DIGITS.sub("0", name)
        elif text:
            literal.append(text)
            other = "S"
        elif number:
            literal.append(number)
            other = "0"
        ids.append(number_of.setdefault(other, len(number_of)))
    lines = content.splitlines() or [""]
    lead: list[str] = []
    for line in lines:
        if not line.strip() or line.startswith("#!"):
            continue
        if not COMMENT.match(line):
            break
        lead.append(line)
    head = "\n".join(lead)
    solid = "".join(content.split())
    literals, runs = "".join(literal), "".join(re.findall(r"[A-Za-z0-9+/=]{50,}", content))
    long_run = len(runs)
    packed = literals if len(literals) >= long_run else runs
    generated = bool(GENERATED_MARK.search(head)) or bool(GENERATED_PATH.search(path))
    minified, config, sheet = bool(MINIFIED_PATH.search(path)), bool(CONFIG.search(path)), bool(SHEET.search(path))
    # the grammar tells whether a file is generated, which is settled for marked files and never asked of others
    settled = generated or minified or config or sheet
    left, rules, uses = (len(ids), 0, 0) if settled else re_pair(np.array(ids, dtype=np.int64))
    share = min(1.0, max(len(literals), long_run) / max(1, len(solid)))
    return {
        "tokens": len(ids),
        "left": left,
        "reuse": uses / rules if rules else 0.0,
        "literal_share": share,
        "literal_ratio": literal_ratio(packed) if share >= DATA_SHARE else 0.0,
        "line_chars": max(len(x) for x in lines),
        "mean_line": len(content) / len(lines),
        "blank_share": 1 - len(solid) / max(1, len(content)),
        "name_chars": name_len / names if names else 0.0,
        "generated_mark": generated,
        "vendor_mark": bool(VENDOR_MARK.search(head)) or bool(VENDOR_PATH.search(path)),
        "licence_mark": bool(LICENCE_MARK.search(head)),
        "minified_mark": minified,
        "config": config,
        "sheet": sheet,
    }


TRAITS = (
    "file_id long, repo string, tokens int, left int, reuse double, literal_share double, literal_ratio double, line_chars int, mean_line double, blank_share double, "
    "name_chars double, generated_mark boolean, vendor_mark boolean, licence_mark boolean, minified_mark boolean, config boolean, sheet boolean, n_lines int, rules array<struct<rule: long, lines: int>>"
)
#: A shared rule must cover so many lines to count: shorter ones are idioms.
LEAST_LINES = 6


def file_table(files: DataFrame) -> DataFrame:
    """Traits and passage rules of each file with content; whole texts are read. One row per file_id.

    files: file_id, system_name, file_path, content. Rows with null or empty content or a null
    file_id have none; a null system_name or file_path counts as empty. Repeated rows count once;
    if they disagree, the row with the larger traits holds.
    """

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, repo, path, content in zip(batch["file_id"], batch["repo"], batch["path"], batch["content"]):
                lines = content.splitlines()
                rules = [(h - (1 << 64) if h >= 1 << 63 else h, n) for h, n in passages(lines) if n >= LEAST_LINES]
                rows.append({"file_id": file_id, "repo": repo, **file_traits(content, path), "n_lines": sum(len("".join(x.split())) > 2 for x in lines), "rules": [{"rule": h, "lines": n} for h, n in rules]})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRAITS.split(", ")[:19]])

    empty = F.lit("")
    rows = files.filter(F.col("file_id").isNotNull() & (F.length("content") > 0)).select(F.col("file_id").cast("long"), F.coalesce("system_name", empty).alias("repo"), plain_path(F.coalesce("file_path", empty)).alias("path"), "content")
    traits = spread(rows).mapInPandas(inspect, TRAITS)
    names = [c for c in traits.columns if c != "file_id"]
    return traits.groupBy("file_id").agg(F.max(F.struct(*names)).alias("t")).select("file_id", "t.*")


def file_origins(files: DataFrame, shared_share: float = 0.4) -> DataFrame:
    """file_id, origin, shared: each file with content, origin being generated, minified, vendored, data or own.

    shared is the share of the file's lines under rules that occur in two or more repositories
    (system_name); a file above `shared_share`, or marked as third-party in its leading comment or
    path, is vendored; a licence in the leading comment is no such mark, but makes a tenth shared enough. Configuration files are own. Of several origins the first of minified,
    data, vendored, generated counts. Small and empty tables need no special case.
    """
    table = cut_lineage(file_table(files))
    rules = table.select("file_id", "repo", F.explode("rules").alias("r")).select("file_id", "repo", "r.*")
    shared = rules.groupBy("rule").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("rule")
    covered = salted_join(rules, shared, ["rule"], ["file_id"]).groupBy("file_id").agg(F.sum("lines").alias("covered"))
    c = F.col
    rest = c("left") / F.greatest(c("tokens"), F.lit(1))
    minified = (c("line_chars") >= 300) & (c("blank_share") <= 0.09) & ((c("name_chars") <= 4) | c("sheet")) | c("minified_mark")
    data = (c("literal_share") >= DATA_SHARE) & (c("literal_ratio") >= 0.3)
    generated = c("generated_mark") | ~c("sheet") & (c("tokens") >= 60) & ((rest < 0.28) | (rest < 0.4) & (c("reuse") >= 9.5))
    share = F.coalesce(c("covered"), F.lit(0)) / F.greatest(c("n_lines"), F.lit(1))
    placed = table.join(covered, "file_id", "left").withColumn("shared", share)
    origin = F.when(c("config"), "own").when(minified, "minified").when(data, "data").when((c("shared") >= shared_share) | c("vendor_mark") | c("licence_mark") & (c("shared") >= 0.1), "vendored").when(generated, "generated").otherwise("own")
    return placed.select("file_id", origin.alias("origin"), "shared")
