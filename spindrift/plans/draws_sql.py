"""DuckDB SQL of the seeded generators' draws: the Mersenne Twister over lists, as common table expressions."""

from __future__ import annotations

WORD = "& 4294967295"
_MIX = "xor({0}, {0} >> 30) * {1}"
#: The words that seeding by a key starts from: one row, list ``b``.
BASE_WORDS = f"""b0 AS (SELECT list_reduce(list_concat([[19650218::BIGINT]], list_transform(range(1, 624), lambda i: [i::BIGINT])), lambda a, x: list_append(a, (1812433253 * xor(a[-1], a[-1] >> 30) + x[1]) {WORD})) AS b)"""


def keyed_words(seeds: str, name: str = "mt") -> str:
    """``name(s, w)``: the words that the standard generator has for each seed ``s`` (below 2**32) of a table."""
    first = f"list_reduce(list_concat([[b[1]]], list_transform(b[2:], lambda x: [x])), lambda a, x: list_append(a, (xor(x[1], ({_MIX.format('a[-1]', 1664525)}) {WORD}) + s) {WORD}))"
    again = f"list_reduce(list_concat([[w1]], list_transform(range(2, 624), lambda i: [p[i + 1], i])), lambda a, x: list_append(a, (xor(x[1], ({_MIX.format('a[-1]', 1566083941)}) {WORD}) - x[2]) {WORD}))"
    return f"""{name}_1 AS (SELECT s, {first} AS p FROM (SELECT DISTINCT s FROM {seeds}) t, b0),
{name}_2 AS (SELECT s, p, (xor(p[2], ({_MIX.format('p[624]', 1664525)}) {WORD}) + s) {WORD} AS w1 FROM {name}_1),
{name}_3 AS (SELECT s, {again} AS q FROM {name}_2),
{name} AS (SELECT s, list_concat([2147483648::BIGINT, (xor(q[1], ({_MIX.format('q[623]', 1566083941)}) {WORD}) - 1) {WORD}], q[2:]) AS w FROM {name}_3)"""


def plain_words(seed: int, name: str = "mt") -> str:
    """``name(s, w)``: the words that the legacy generator has for one seed."""
    return f"{name} AS (SELECT {seed}::BIGINT AS s, list_reduce(list_concat([[{seed}::BIGINT]], list_transform(range(1, 624), lambda i: [i::BIGINT])), lambda a, x: list_append(a, (1812433253 * xor(a[-1], a[-1] >> 30) + x[1]) {WORD})) AS w)"


def _step(u: str, v: str) -> str:
    return f"xor((({u} & 2147483648) | ({v} & 2147483647)) >> 1, ({v} & 1) * 2567483615)"


def twisted(words: str, blocks: str, name: str = "tw") -> str:
    """``name(s, k, w)``: the blocks 1 to ``blocks`` (an SQL expression) of words after those of ``words(s, w)``. Needs
    WITH RECURSIVE."""
    a = f"list_transform(range(1, 228), lambda i: xor(w[i + 397], {_step('w[i]', 'w[i + 1]')}))"
    b = f"list_transform(range(228, 455), lambda i: xor(a[i - 227], {_step('w[i]', 'w[i + 1]')}))"
    c = f"list_transform(range(455, 624), lambda i: xor(b[i - 454], {_step('w[i]', 'w[i + 1]')}))"
    last = f"xor(b[170], {_step('w[624]', 'a[1]')})"
    return f"""{name}(s, k, w) AS (SELECT s, 0, w FROM {words} UNION ALL
SELECT s, k + 1, list_concat(a, b, c, [{last}]) FROM (SELECT *, {c} AS c FROM (SELECT *, {b} AS b FROM (SELECT *, {a} AS a FROM {name} WHERE k < {blocks}) x) y) z)"""


#: Draws that are tried from each seed, and steps whose words are listed together.
TRIES, CHUNK = 20, 24


def keyed_heads(seeds: str, name: str = "mt") -> str:
    """``name(s, h)``: of the words of many seeds ``s`` (below 2**32) those that the first draws need: words 0 to
    ``TRIES``, then ``TRIES`` from 397. Steps are listed in chunks, as appending to a long list copies it."""
    step = lambda f: f"(xor(x[1], (xor(a[-1], a[-1] >> 30) * {f}) {WORD})"
    scan = lambda first, rows, then: f"list_reduce(list_concat([[{first}]], {rows}), lambda a, x: {then})"
    inner, last = f"SELECT s, b, [b[1]] AS c0 FROM (SELECT DISTINCT s FROM {seeds}) t, b0", 0
    for at in range(2, 625, CHUNK):
        grown = scan(f"c{last}[-1]", f"list_transform(b[{at}:{min(624, at + CHUNK - 1)}], lambda x: [x])", f"list_append(a, {step(1664525)} + s) {WORD})")
        inner, last = f"SELECT *, {grown} AS c{last + 1} FROM ({inner}) u", last + 1
    whole = "list_concat([b[1]], flatten([" + ", ".join(f"c{i}[2:]" for i in range(1, last + 1)) + "]))"
    rows = lambda a, b: f"list_transform(range({a}, {b}), lambda i: [p[i + 1], i])"
    after = f"{step(1566083941)} - x[2]) {WORD}"
    near, far = TRIES + 1, 397 + TRIES
    return f"""{name}_1 AS (SELECT s, {whole} AS p FROM ({inner}) u),
{name}_2 AS (SELECT s, p, (xor(p[2], ({_MIX.format('p[624]', 1664525)}) {WORD}) + s) {WORD} AS w1 FROM {name}_1),
{name}_3 AS (SELECT *, {scan('w1', rows(2, near), f'list_append(a, {after})')} AS n FROM {name}_2),
{name}_4 AS (SELECT *, {scan('n[-1]', rows(near, 397), f'[{after}]')} AS z FROM {name}_3),
{name}_5 AS (SELECT *, {scan('z[-1]', rows(397, far), f'list_append(a, {after})')} AS f FROM {name}_4),
{name}_6 AS (SELECT *, {scan('f[-1]', rows(far, 624), f'[{after}]')} AS q FROM {name}_5),
{name} AS (SELECT s, list_concat([2147483648::BIGINT, (xor(w1, ({_MIX.format('q[-1]', 1566083941)}) {WORD}) - 1) {WORD}], list_concat(n[2:], f[2:])) AS h FROM {name}_6)"""


def first_draw(heads: str, n: str) -> str:
    """What is drawn first below ``n`` (an SQL expression) from the heads of a seeded generator."""
    word = f"xor({heads}[i + {TRIES + 1}], {_step(f'{heads}[i]', f'{heads}[i + 1]')})"
    outputs = f"list_transform(range(1, {TRIES + 1}), lambda i: {word})"
    for s in ("xor(y, y >> 11)", "xor(y, (y << 7) & 2636928640)", "xor(y, (y << 15) & 4022730752)", "xor(y, y >> 18)"):
        outputs = f"list_transform({outputs}, lambda y: {s})"
    return f"list_filter(list_transform({outputs}, lambda y: y >> (32 - length(bin({n})))), lambda y: y < {n})[1]"


def outputs(blocks: str, name: str = "mo") -> str:
    """``name(s, o)``: the outputs of all blocks after the first words, in order."""
    out = "flatten(list(w ORDER BY k))"
    for y in ("xor(y, y >> 11)", "xor(y, (y << 7) & 2636928640)", "xor(y, (y << 15) & 4022730752)", "xor(y, y >> 18)"):
        out = f"list_transform({out}, lambda y: {y})"
    return f"{name} AS (SELECT s, {out} AS o FROM {blocks} WHERE k > 0 GROUP BY s)"


def falling_draws(o: str, n: str, k: str) -> str:
    """The first ``k`` draws below n, n - 1, ... from a list of outputs; what is not below is skipped."""
    left = f"({n} - len(a))"
    good = f"len(a) < {k} AND (x[1] >> (32 - length(bin({left})))) < {left}"
    return f"list_reduce(list_concat([CAST([] AS BIGINT[])], list_transform({o}, lambda y: [y])), lambda a, x: CASE WHEN {good} THEN list_append(a, x[1] >> (32 - length(bin({left})))) ELSE a END)"


def swapped(n: str, draws: str) -> str:
    """The ranks below ``n`` after the t-th draw has been swapped with place n - t, for all draws."""
    i, j = "e[2]", "e[1]"
    swap = f"list_concat(list_concat(a[1:{j}], [a[{i} + 1]]), list_concat(a[{j} + 2:{i}], list_concat([a[{j} + 1]], a[{i} + 2:])))"
    return f"list_reduce(list_concat([list_transform(range(0, {n}), lambda r: r::BIGINT)], list_transform({draws}, lambda r, t: [r, ({n} - t)::BIGINT])), lambda a, e: CASE WHEN {i} = {j} THEN a ELSE {swap} END)"
