"""Sources: frames, stores, audio and fixtures as DataFrames."""
