NO_ID = -(2**63)


def null_first(i):
    return NO_ID if i is None else i


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
