"""The closed-form fold against a sequential interpreter of the same rules."""

import random

from kvloom.operators import fold

NAMES = ["a", "b"]


class Node:
    """A namespace: scalars and children by key, and the number of its log entries."""

    def __init__(self):
        self.keys, self.entries = {}, 0


def interpret(script):
    root = Node()

    def walk(segments, make):
        node = root
        for s in segments:
            child = node.keys.get(s)
            if not isinstance(child, Node):
                if not make:
                    return None
                node.entries += 1
                child = node.keys[s] = Node()
            node = child
        return node

    for op, path, value in script:
        if op in ("COMPACT", "RESET"):
            node = walk([s for s in path.split("/") if s], False)
            if node is not None:
                node.entries = len(node.keys) if op == "COMPACT" else 0
            continue
        cut = path.split("/")
        segments = [s for s in cut[:-1] if s] + [cut[-1]]
        key = segments[-1]
        node = walk(segments[:-1], op in ("PUT", "SPAWN"))
        if node is None:
            continue
        held = node.keys.get(key)
        if op == "PUT" and not isinstance(held, Node):
            node.keys[key] = value
            node.entries += 1
        elif op in ("DEL", "DROP"):
            node.keys.pop(key, None)
            node.entries += op == "DEL"
        elif op == "SPAWN":
            node.entries += 1
            if not isinstance(held, Node):
                node.keys[key] = Node()
        elif op == "CONVERT" and not isinstance(held, Node):
            node.entries += 2
            node.keys[key] = Node()
    state, counts = [], []

    def show(node, ns):
        counts.append((ns, node.entries))
        for k, v in node.keys.items():
            state.append((ns, k, None if isinstance(v, Node) else v))
            if isinstance(v, Node):
                show(v, f"{ns}/{k}")

    show(root, "root")
    return sorted(state, key=str), sorted(counts)


def scripts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        out = []
        for _ in range(rng.randint(1, 14)):
            path = "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 4)))
            path = rng.choice(["", "", "", "/"]) + path + rng.choice(["", "", "", "", "/"])
            out.append((rng.choice(["PUT", "PUT", "PUT", "PUT", "DEL", "DEL", "SPAWN", "CONVERT", "COMPACT", "DROP", "RESET"]), path, str(rng.randint(0, 99))))
        yield out


def test_closed_form_equals_the_interpreter(spark, monkeypatch):
    """All scripts in one log: each below a namespace of its own, which is spawned first and so stands for the root."""
    monkeypatch.setattr(fold, "BUCKET_ROWS", 200)
    rows, expected_state, expected_counts = [], [], []
    for i, script in enumerate(scripts(150, 1)):
        rows.append((len(rows) + 1, "SPAWN", f"s{i}", ""))
        rows += [(len(rows) + 1 + j, op, f"s{i}/{path}", value) for j, (op, path, value) in enumerate(script)]
        state, counts = interpret(script)
        expected_state += [(f"root/s{i}" + ns[4:], k, v) for ns, k, v in state]
        expected_counts += [(f"root/s{i}" + ns[4:], n) for ns, n in counts]
    log = spark.createDataFrame(rows, "seq long, op string, path string, value string")
    got = [(r.ns, r.key, None if r.type == "SUB" else r.value) for r in fold.state(log).collect()]
    assert sorted((x for x in got if x[0] != "root"), key=str) == sorted(expected_state, key=str)
    counts = [(r.ns, r.total_entries) for r in fold.entry_counts(log).collect()]
    assert sorted(x for x in counts if x[0] != "root") == sorted(expected_counts)
