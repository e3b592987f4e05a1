from tidebook.functions import identity, jsonfields, levels, numbers, timeparts  # noqa: F401
