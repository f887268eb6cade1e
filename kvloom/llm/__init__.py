"""Operations of a training-data pipeline. Nothing else in kvloom imports this subpackage."""
