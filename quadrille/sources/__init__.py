"""Reading and writing of points, cell counts, neighbour lists and trees."""
