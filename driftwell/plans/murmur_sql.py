"""MurmurHash3 of integers and bytes spelled out in SQL, for the statements that check our hashes.

One common table expression a step, so that no expression is written twice inside another.
"""

from __future__ import annotations

from driftwell.functions.hashing import ADD1_64, ADD2_64, ADD_32, C1_32, C1_64, C2_32, C2_64, FMIX1_32, FMIX1_64, FMIX2_32, FMIX2_64

_TWO32 = 4294967296


def _times(x: str, c: int) -> str:
    return f"(({x}::HUGEINT * {c}) % {_TWO32})::BIGINT"


def _rotl(x: str, r: int) -> str:
    return f"(({x} * {1 << r}) % {_TWO32} + ({x} // {1 << (32 - r)}))"


def murmur_ctes(name: str, source: str, keep: str, length: int = 8) -> str:
    """CTEs that end in ``name``: (keep columns, seed, h) for ``source`` with columns keep, id, seed.

    ``id`` must not be negative; ``length`` is 8 for longs and 4 for ints.
    """
    steps = [f"{name}_0 AS (SELECT {keep}, seed, seed::BIGINT AS h, id % {_TWO32} AS b0, id // {_TWO32} AS b1 FROM {source})"]
    at = 0

    def step(h: str, k: str = "0") -> None:
        nonlocal at
        at += 1
        steps.append(f"{name}_{at} AS (SELECT {keep}, seed, b0, b1, {h} AS h, {k} AS k FROM {name}_{at - 1})")

    for block in ("b0", "b1")[: length // 4]:
        step("h", _times(block, C1_32))
        step("h", _rotl("k", 15))
        step("h", _times("k", C2_32))
        step("xor(h, k)")
        step(_rotl("h", 13))
        step(f"(h * 5 + {ADD_32}) % {_TWO32}")
    step(f"xor(h, {length})")
    for shift, factor in ((16, FMIX1_32), (13, FMIX2_32), (16, None)):
        step(f"xor(h, h // {1 << shift})")
        if factor:
            step(_times("h", factor))
    steps.append(f"{name} AS (SELECT {keep}, seed, h FROM {name}_{at})")
    return ",\n".join(steps)


def murmur_bytes_ctes(name: str, source: str, keep: str) -> str:
    """CTEs that end in ``name``: (keep columns, seed, h), MurmurHash3 x86_32 of the bytes in the column hx (hex) of ``source``."""

    def word(at: str) -> str:
        return "('0x0' || " + " || ".join(f"substr(hx, {at} + {i}, 2)" for i in (7, 5, 3, 1)) + ")::BIGINT"

    x = "xor(a, k)"
    turned = f"(({x} * {1 << 13}) % {_TWO32} + ({x} // {1 << 19}))"
    steps = [
        f"{name}_w AS (SELECT {keep}, seed, length(hx) // 2 AS n, list_transform(range(length(hx) // 8), lambda i: {word('8 * i')}) AS w, {word('length(hx) // 8 * 8')} AS t FROM {source})",
        f"{name}_1 AS (SELECT {keep}, seed, n, list_transform(w, lambda x: {_times('x', C1_32)}) AS w, {_times('t', C1_32)} AS t FROM {name}_w)",
        f"{name}_2 AS (SELECT {keep}, seed, n, list_transform(w, lambda x: {_rotl('x', 15)}) AS w, {_rotl('t', 15)} AS t FROM {name}_1)",
        f"{name}_3 AS (SELECT {keep}, seed, n, list_transform(w, lambda x: {_times('x', C2_32)}) AS w, {_times('t', C2_32)} AS t FROM {name}_2)",
        f"{name}_4 AS (SELECT {keep}, seed, xor(xor(list_reduce(list_prepend(seed::BIGINT, w), lambda a, k: ({turned} * 5 + {ADD_32}) % {_TWO32}), t), n) AS h FROM {name}_3)",
    ]
    at = 4
    for shift, factor in ((16, FMIX1_32), (13, FMIX2_32), (16, None)):
        steps.append(f"{name}_{at + 1} AS (SELECT {keep}, seed, xor(h, h // {1 << shift}) AS h FROM {name}_{at})")
        at += 1
        if factor:
            steps.append(f"{name}_{at + 1} AS (SELECT {keep}, seed, {_times('h', factor)} AS h FROM {name}_{at})")
            at += 1
    steps.append(f"{name} AS (SELECT {keep}, seed, h FROM {name}_{at})")
    return ",\n".join(steps)


_TWO64 = 1 << 64


def _times64(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % {_TWO64}::UHUGEINT)::UBIGINT"


def _plus64(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % {_TWO64}::UHUGEINT)::UBIGINT"


def _rotl64(x: str, r: int) -> str:
    return f"((({x})::UHUGEINT * {1 << r}::UHUGEINT) % {_TWO64}::UHUGEINT + ({x})::UHUGEINT // {1 << (64 - r)}::UHUGEINT)::UBIGINT"


def murmur128_ctes(name: str, source: str, keep: str) -> str:
    """CTEs that end in ``name``: (keep columns, h1, h2 as UBIGINT), MurmurHash3 x64_128 with seed 0 of the bytes in hx (hex)."""

    def word(at: str) -> str:
        return "('0x0' || " + " || ".join(f"substr(hx, {at} + {i}, 2)" for i in (15, 13, 11, 9, 7, 5, 3, 1)) + ")::UBIGINT"

    tail = "length(hx) // 32 * 32"
    rows = [f"{name}_w AS (SELECT {keep}, (length(hx) // 2)::UBIGINT AS n, list_transform(range(length(hx) // 32), lambda i: {{'a': {word('32 * i')}, 'b': {word('32 * i + 16')}}}) AS w, {{'a': {word(tail)}, 'b': {word(tail + ' + 16')}}} AS t FROM {source})"]
    at = "w"
    for i, (first, second) in enumerate((
        (lambda x: _times64(x, C1_64), lambda x: _times64(x, C2_64)),
        (lambda x: _rotl64(x, 31), lambda x: _rotl64(x, 33)),
        (lambda x: _times64(x, C2_64), lambda x: _times64(x, C1_64)),
    )):
        pair = lambda x: f"{{'a': {first(x + '.a')}, 'b': {second(x + '.b')}}}"  # noqa: B023, E731
        rows.append(f"{name}_{i} AS (SELECT {keep}, n, list_transform(w, lambda x: {pair('x')}) AS w, {pair('t')} AS t FROM {name}_{at})")
        at = str(i)
    one = _plus64(f"(({_plus64(_rotl64('xor(s.a, k.a)', 27), 's.b')})::UHUGEINT * 5::UHUGEINT) % {_TWO64}::UHUGEINT", str(ADD1_64))
    two = _plus64(f"(({_plus64(_rotl64('xor(s.b, k.b)', 31), one)})::UHUGEINT * 5::UHUGEINT) % {_TWO64}::UHUGEINT", str(ADD2_64))
    zero = "{'a': 0::UBIGINT, 'b': 0::UBIGINT}"
    rows.append(f"{name}_3 AS (SELECT {keep}, n, list_reduce(list_prepend({zero}, w), lambda s, k: {{'a': {one}, 'b': {two}}}) AS s, t FROM {name}_2)")
    rows.append(f"{name}_4 AS (SELECT {keep}, xor(xor(s.a, t.a), n) AS h1, xor(xor(s.b, t.b), n) AS h2 FROM {name}_3)")
    at_step = 4

    def step(h1: str, h2: str) -> None:
        nonlocal at_step
        rows.append(f"{name}_{at_step + 1} AS (SELECT {keep}, {h1} AS h1, {h2} AS h2 FROM {name}_{at_step})")
        at_step += 1

    def summed() -> None:
        step(_plus64("h1", "h2"), "h2")
        step("h1", _plus64("h1", "h2"))

    summed()
    for factor in (FMIX1_64, FMIX2_64, None):
        step(*(f"xor({h}, {h} // {1 << 33}::UBIGINT)" for h in ("h1", "h2")))
        if factor:
            step(_times64("h1", factor), _times64("h2", factor))
    summed()
    rows.append(f"{name} AS (SELECT {keep}, h1, h2 FROM {name}_{at_step})")
    return ",\n".join(rows)


def signed64(h: str) -> str:
    """An unsigned 64-bit value as the signed long of the same bits."""
    return f"CASE WHEN {h} >= {1 << 63}::UBIGINT THEN (({h})::HUGEINT - {_TWO64}::HUGEINT)::BIGINT ELSE ({h})::BIGINT END"


def utf16_hex(text: str) -> str:
    """Hex of the UTF-16LE bytes of an ASCII text."""
    return f"regexp_replace(hex(encode({text})), '(..)', '\\1' || '00', 'g')"
