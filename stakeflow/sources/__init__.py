from stakeflow.sources.tables import Tables

__all__ = ["Tables"]
