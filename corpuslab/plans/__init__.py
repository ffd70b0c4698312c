"""Queries over the given tables. `load()` imports the modules that register them."""


def load():
    import importlib

    for module in MODULES:
        importlib.import_module(f"corpuslab.plans.{module}")
    from corpuslab.plans import registry

    return registry


MODULES = ["text_queries", "vector_queries", "mining_queries", "evaluation_queries", "corpus_queries"]
