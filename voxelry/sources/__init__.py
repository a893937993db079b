"""Reading and writing volumes, label sets, slice series and annotations."""
