"""Writers: batch slices, training tables, WAV files and their manifest."""
