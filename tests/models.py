"""Sequential models that the tests compare with."""

from stratalog.functions.hashing import shard_number


def replay(log):
    """State and replies of one group's log, command by command."""
    state, sessions, shards, replies = {}, {}, {}, {}
    for c in sorted(log, key=lambda c: c["idx"]):
        client = c["client_id"] or 0
        if client and client in sessions and c["req_seq"] <= sessions[client][0] and c["op"] != "register":
            replies[c["idx"]] = (True, sessions[client][1])
            continue
        found, value, success, new_client, moving = False, None, False, 0, False
        op, key = c["op"], c["key"]
        at = shards.get(shard_number(key)) if op in ("put", "delete", "cas", "get") else None
        if op == "register":
            new_client = c["idx"]
        elif op in ("put", "delete", "cas"):
            if at not in (None, 0):
                moving = True
            elif op == "put":
                state[key], success = c["value"], True
            elif op == "delete":
                state.pop(key, None)
                success = True
            else:
                found, value = key in state, state.get(key)
                success = value == c["expected"] if c["expected"] is not None else not found
                if success:
                    state[key] = c["value"]
        elif op == "get":
            if at == 2:
                moving = True
            else:
                found, value = key in state, state.get(key)
        elif op == "freeze":
            if shards.get(c["shard"]) != 2:
                shards[c["shard"]] = 1
            success = True
        elif op == "import":
            if shards.get(c["shard"]) in (None, 2):
                for k, v in c["kvs"] or []:
                    state[k] = v
                if c["last"]:
                    shards[c["shard"]] = 0
                success = True
        elif op == "purge":
            for k in [k for k in state if shard_number(k) == c["shard"]]:
                del state[k]
            shards[c["shard"]] = 2
            success = True
        result = (found, value, success, new_client, moving)
        if client:
            sessions[client] = (c["req_seq"], result)
        if new_client:
            sessions[new_client] = (0, None)
        replies[c["idx"]] = (False, result)
    return state, replies


def pick(sizes, min_run=4, max_tables=10):
    """Positions of the segments to merge."""
    best = None
    i = 0
    while i < len(sizes):
        j = i + 1
        while j < len(sizes) and sizes[j] <= 2 * sizes[i] and sizes[i] <= 2 * sizes[j]:
            j += 1
        if j - i >= min_run and (best is None or j - i >= len(best)):
            best = list(range(i, j))
        i = j
    if best is None and len(sizes) > max_tables:
        best = list(min((range(i, i + min_run) for i in range(len(sizes) - min_run + 1)), key=lambda w: sum(sizes[k] for k in w)))
    return best or []
