"""Business queries: every public function is ``name(tables, **params) -> DataFrame``."""
