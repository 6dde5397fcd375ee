"""Random op logs and a sequential model to compare with."""

import random

LOG = "seq bigint, ts bigint, op string, key string, value string, expireAt bigint, items array<struct<key string, value string>>, keys array<string>"


def random_log(seed, n=60, keys="abcd", reads=True, flush=0.03):
    rnd, out, ts = random.Random(seed), [], 0
    ops = ["SET"] * 5 + ["DEL"] * 2 + ["MSET", "MUPD", "MUPD", "MDEL"] + (["GET"] * 3 if reads else [])
    for seq in range(n):
        ts += rnd.randint(0, 3)
        op = "FLUSH" if rnd.random() < flush else rnd.choice(ops)
        exp = rnd.choice([0, 0, None, ts + rnd.randint(-2, 12)])
        key = rnd.choice(keys) if op in ("SET", "DEL", "GET") else None
        items = [(rnd.choice(keys), f"v{seq}.{i}") for i in range(rnd.randint(0, 3))] if op in ("MSET", "MUPD") else None
        names = [rnd.choice(keys) for _ in range(rnd.randint(0, 3))] if op == "MDEL" else None
        out.append((seq, ts, op, key, f"v{seq}" if op == "SET" else None, exp if op in ("SET", "MSET", "MUPD") else None, items, names))
    return out


def sequential(log, now):
    """State {key: (value, exp, ts)} at ``now``, replies {(seq, pos): (existed, old)}."""
    state, told = {}, {}
    there = lambda k, t: k in state and (state[k][1] <= 0 or t < state[k][1])
    for seq, ts, op, key, value, exp, items, keys in log:
        exp = exp or 0
        pairs = [(key, value)] if op == "SET" else items if op in ("MSET", "MUPD") else [(key, None)] if op in ("DEL", "GET") else [(k, None) for k in keys or []]
        if op == "FLUSH":
            state.clear()
            continue
        for pos, (k, v) in enumerate(pairs or []):
            was = there(k, ts)
            told[seq, pos] = (was, state[k][0] if was else None)
            if op in ("SET", "MSET") or (op == "MUPD" and was):
                state[k] = (v, exp, ts)
            elif op in ("DEL", "MDEL"):
                state.pop(k, None)
    return {k: x for k, x in state.items() if there(k, now)}, told
