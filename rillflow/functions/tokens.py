"""Token arrays: masks, padding, running sums and recurrences as column expressions.

One row is one sequence; nothing is exploded. Recurrences fold an array from its end with ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Arr = Column | str


def _c(x: Arr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every item of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Arr) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda a, x: a + x)


def masked_sum(values: Arr, mask: Arr) -> Column:
    """Sum where the mask is set; NaN elsewhere doesn't count."""
    return total(F.zip_with(_c(values), _c(mask), lambda v, m: F.when(m != 0, v.cast("double")).otherwise(0.0)))


def masked_mean(values: Arr, mask: Arr) -> Column:
    return masked_sum(values, mask) / (total(_c(mask)) + 1e-8)


def masked_var(values: Arr, mask: Arr, unbiased: bool = True) -> Column:
    """Variance around the masked mean; unbiased over masks that sum to 0 or 1 is an error."""
    n = total(_c(mask))
    var = let(masked_mean(values, mask), lambda mean: masked_mean(F.transform(_c(values), lambda v: (v - mean) * (v - mean)), mask))
    if not unbiased:
        return var
    return F.when(n <= 1, F.raise_error(F.lit("the mask must have two tokens at least")).cast("double")).otherwise(var * n / (n - 1))


def masked_whiten(values: Arr, mask: Arr, shift_mean: bool = True) -> Column:
    back = F.lit(0.0) if shift_mean else masked_mean(values, mask)
    stats = F.struct(masked_mean(values, mask).alias("mean"), masked_var(values, mask).alias("var"), back.alias("back"))
    return let(stats, lambda s: F.transform(_c(values), lambda v: (v - s.getField("mean")) / F.sqrt(s.getField("var") + 1e-8) + s.getField("back")))


def response_mask(ids: Arr, eos: tuple[int, ...]) -> Column:
    """1 up to the first end id, it included."""
    ends = F.transform(_c(ids), lambda x: x.isin(*eos))
    at = F.array_position(ends, F.lit(True))
    return F.transform(_c(ids), lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Arr) -> Column:
    """clip(cumsum(mask) - 1, 0)."""
    return F.transform(_c(mask), lambda m, i: F.greatest(F.aggregate(F.slice(_c(mask), 1, i + 1), F.lit(0), lambda a, x: a + x) - 1, F.lit(0)))


def fold_back(items: Column, start: Column, step) -> Column:
    """Fold from the last item to the first. ``step(state, item)`` gives the next state, a struct with ``out``: results so far, last first."""
    return F.reverse(F.aggregate(F.reverse(items), start, step).getField("out"))


def _empty() -> Column:
    return F.expr("cast(array() as array<double>)")


def discounted_returns(rewards: Arr, mask: Arr, gamma: float = 1.0, reset: bool = True) -> Column:
    """Running return from the end; with ``reset`` it starts anew before a masked-out token, whose own return is kept."""

    def step(s: Column, x: Column) -> Column:
        g = x.getField("r") + gamma * s.getField("g")
        after = g * x.getField("m") if reset else g
        return F.struct(after.alias("g"), F.concat(s.getField("out"), F.array(g)).alias("out"))

    items = F.zip_with(_c(rewards), _c(mask), lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m")))
    return fold_back(items, F.struct(F.lit(0.0).alias("g"), _empty().alias("out")), step)


def gae(rewards: Arr, values: Arr, mask: Arr, gamma: float, lam: float) -> Column:
    """Advantages before whitening. Masked tokens hand the next value and the running sum on unchanged."""

    def step(s: Column, x: Column) -> Column:
        m, v = x.getField("m"), x.getField("v")
        now = x.getField("r") + gamma * s.getField("nv") - v + gamma * lam * s.getField("g")
        g = now * m + (1 - m) * s.getField("g")
        return F.struct((v * m + (1 - m) * s.getField("nv")).alias("nv"), g.alias("g"), F.concat(s.getField("out"), F.array(g)).alias("out"))

    items = F.transform(
        F.arrays_zip(_c(rewards).alias("r"), _c(values).alias("v"), _c(mask).alias("m")),
        lambda x: F.struct(x.getField("r").cast("double").alias("r"), x.getField("v").cast("double").alias("v"), x.getField("m").cast("double").alias("m")),
    )
    return fold_back(items, F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("g"), _empty().alias("out")), step)


def pad(ids: Arr, length: int, fill: int, left: bool = False) -> Column:
    """Padded to ``length``; longer arrays stay."""
    more = F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(F.lit(length) - F.size(_c(ids)), F.lit(0)))
    return F.concat(more, _c(ids)) if left else F.concat(_c(ids), more)


def fit(ids: Arr, length: int, fill: int, left_pad: bool = True, truncation: str = "error") -> Column:
    """Padded or cut to ``length``: left keeps the tail, right the head, middle the first half and the rest from the end, error raises."""
    a, n = _c(ids), F.size(_c(ids))
    half = length // 2
    cuts = {
        "left": F.slice(a, F.lit(-length), F.lit(length)),
        "right": F.slice(a, 1, length),
        "middle": F.concat(F.slice(a, 1, half), F.slice(a, F.lit(-(length - half)), F.lit(length - half))),
        "error": F.raise_error(F.lit(f"sequence longer than {length}")).cast("array<bigint>"),
    }
    if truncation not in cuts:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(n > length, cuts[truncation]).otherwise(pad(a, length, fill, left_pad))


def strip_left_pad(ids: Arr, mask: Arr) -> Column:
    n = F.aggregate(_c(mask), F.lit(0), lambda a, x: a + x.cast("int"))
    return F.slice(_c(ids), F.size(_c(ids)) - n + 1, n)


def common_prefix(a: Arr, b: Arr) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same).cast("bigint")).otherwise(first - 1)


def is_prefix(a: Arr, b: Arr, strict: bool = False) -> Column:
    fits = (F.size(_c(a)) <= F.size(_c(b))) & (F.slice(_c(b), F.lit(1), F.size(_c(a))) == _c(a))
    return fits & (F.size(_c(a)) < F.size(_c(b))) if strict else fits


def append_eos(ids: Arr, eos: int) -> Column:
    a = _c(ids)
    return F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1) == eos), a).otherwise(F.concat(a, F.array(F.lit(eos).cast("bigint"))))


def digest(ids: Arr) -> Column:
    """sha1 of the ids joined by commas."""
    return F.sha1(F.array_join(_c(ids).cast("array<string>"), ","))


def trim(ids: Arr, most: int) -> Column:
    """Head and tail of a long array, and its length."""
    a, half = _c(ids), most // 2
    return F.struct(F.slice(a, 1, half).alias("head"), F.when(F.size(a) > most, F.slice(a, F.lit(-half), F.lit(half))).otherwise(F.slice(a, half + 1, most)).alias("tail"), F.size(a).alias("n"))


def trim_text(text: Arr, most: int) -> Column:
    return F.when(F.length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most), F.lit("..."))).otherwise(_c(text))


def log_sum_exp(logits: Arr) -> Column:
    return let(F.array_max(_c(logits)), lambda top: top + F.log(total(F.transform(_c(logits), lambda x: F.exp(x - top)))))


def entropy(logits: Arr) -> Column:
    """log-sum-exp less the mean logit under the softmax."""
    return let(log_sum_exp(logits), lambda z: z - total(F.transform(_c(logits), lambda x: F.exp(x - z) * x)))


def log_prob(logits: Arr, label: Arr) -> Column:
    return F.get(_c(logits), _c(label)) - log_sum_exp(logits)


def scale(logits: Arr, temperature: float) -> Column:
    return F.transform(_c(logits), lambda x: x / temperature)


def clip(x: Arr, low: Arr | float, high: Arr | float) -> Column:
    lift = lambda v: F.lit(v) if isinstance(v, (int, float)) else _c(v)
    return F.greatest(F.least(_c(x), lift(high)), lift(low))


def spans_at_stops(ids: Arr, stops: tuple[int, ...]) -> Column:
    """(start, end) of the parts that end after a stop id; the tail is a part, and an empty array is one empty part."""
    n = F.size(_c(ids))
    ends = F.filter(F.transform(_c(ids), lambda x, i: F.when(x.isin(*stops), i + 1)), lambda x: x.isNotNull())
    ends = F.when(F.get(ends, F.size(ends) - 1) == n, ends).otherwise(F.concat(ends, F.array(n)))
    return F.transform(ends, lambda e, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("start"), e.alias("end")))


def spans_of(ids: Arr, length: int) -> Column:
    """Parts of ``length`` tokens, the last one shorter."""
    n = F.size(_c(ids))
    return F.when(n == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(length)), lambda s: F.struct(s.alias("start"), F.least(s + length, n).alias("end")))
    )


def spans_in(ids: Arr, parts: int) -> Column:
    """``parts`` near-equal parts (no more than tokens), longer ones first."""
    n = F.size(_c(ids))
    k = F.greatest(F.least(F.lit(parts), n), F.lit(1))
    base, extra = F.floor(n / k).cast("int"), n % k
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((i * base + F.least(i, extra)).alias("start"), ((i + 1) * base + F.least(i + 1, extra)).alias("end")))


def chain_nodes(prompt: Arr, response: Arr, spans: Column) -> Column:
    """(prompt, ids) of the nodes that ``spans`` (start, end) cut a response into: each one's prompt ends where the one before it ends."""
    return F.transform(spans, lambda s: F.struct(F.concat(_c(prompt), F.slice(_c(response), F.lit(1), s["start"])).alias("prompt"), F.slice(_c(response), s["start"] + 1, s["end"] - s["start"]).alias("ids")))


def rectangle(rows, prompt: str, response: str, mask: str, most_prompt: int, most_response: int, pad: int = 0):
    """``rows`` with ``ids`` of ``most_prompt`` + ``most_response`` (the prompt's last ones padded on the left, the response's first ones on the right), ``attention``,
    ``response_mask`` (padding is 0), ``positions`` (counted from the first real token; padding repeats the nearest) and ``reward_at``, the place of the response's last token."""
    p, r = F.slice(_c(prompt), F.greatest(F.size(prompt) - most_prompt + 1, F.lit(1)), most_prompt), F.slice(_c(response), 1, most_response)
    k, n = F.least(F.size(prompt), F.lit(most_prompt)), F.least(F.size(response), F.lit(most_response))
    kind = lambda c: rows.schema[c].dataType.elementType.simpleString()
    fill = lambda c, by, size: F.array_repeat(F.lit(by).cast(kind(c)), size)
    one = lambda by, size: F.array_repeat(F.lit(by), size)
    before, after = F.lit(most_prompt) - k, F.lit(most_response) - n
    places = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(most_prompt - 1)), lambda i: F.greatest(i - (most_prompt - F.least(F.size(prompt), F.lit(most_prompt))), F.lit(0))),
        F.transform(F.sequence(F.lit(0), F.lit(most_response - 1)), lambda i: F.least(F.size(prompt), F.lit(most_prompt)) + F.least(i, F.greatest(F.least(F.size(response), F.lit(most_response)), F.lit(1)) - 1)),
    )
    return rows.withColumns({
        "positions": places, "ids": F.concat(fill(prompt, pad, before), p, r, fill(prompt, pad, after)), "attention": F.concat(one(0, before), one(1, k), one(1, n), one(0, after)),
        "response_mask": F.concat(F.slice(_c(mask), 1, most_response), fill(mask, 0, after)), "reward_at": F.when(n > 0, n - 1),
    })


def unfold(array: Arr, parts: int) -> Column:
    """``parts`` equal slices of an array, as an array."""
    size = (F.size(_c(array)) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(_c(array), i * size + 1, size))


def truncate(ids: Arr, response: Arr, most: int, most_response: int) -> Column:
    """(ids, response): both cut at their limits, from the end."""
    return F.struct(F.slice(_c(ids), 1, most).alias("ids"), F.slice(_c(response), 1, most_response).alias("response"))


def supervised_mask(mask: Arr, prompt: Column, response: Column, prefix: Arr, answer: Arr) -> Column:
    """A loss mask over a padded sequence: the prompt but for its last token, the response's last token and the response's
    longest common prefix with ``prefix`` (null or empty: none) count 0. ``prompt`` and ``response`` are lengths."""
    n = F.size(_c(mask))
    begin = F.greatest(prompt - 1, F.lit(0))
    match = F.coalesce(common_prefix(prefix, answer), F.lit(0))
    end = F.least(prompt + response, n) - 1
    hidden = lambda i: ((prompt > 1) & (i < F.least(prompt, n) - 1)) | (i == end) | ((i >= begin) & (i < begin + match))
    return F.transform(_c(mask), lambda m, i: F.when(hidden(i), 0).otherwise(m))
